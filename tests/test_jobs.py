import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from echofold import schemas as S
from echofold.operators import duplicates as D
from echofold.plans import inventory as I
from echofold.plans.analysis import NoCompletedRun, duplicates_over, top_duplicates
from echofold.operators.runs import latest_runs
from echofold.plans.cleanup import cleanup_execute, cleanup_in_place, cleanup_plan, cleanup_tables
from echofold.plans.inventory import InventoryOptions, inventory_of_listing, inventory_of_roots
from echofold.plans.pipeline import ChainOptions, after_inventory
from echofold.plans.report import in_report_order, write_report, yaml_lines
from echofold.sources import listing as L
from echofold.sources import storage
from echofold.sources.store import Inventory, utc_now
from echofold.staging import stage


@pytest.fixture
def drives(tmp_path):
    """Two roots of real files: ``d2/copy`` repeats ``d1/music``."""
    for path, text in {
        "d1/music/a.mp3": "aaaa", "d1/music/live/b.mp3": "bb", "d1/note.txt": "n",
        "d2/copy/x.mp3": "aaaa", "d2/copy/y.mp3": "bb", "d2/other.txt": "o",
    }.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return [str(tmp_path / "d1"), str(tmp_path / "d2")]


@pytest.fixture
def store(spark, tmp_path, drives):
    return inventory_of_roots(spark, str(tmp_path / "inventory"), "b1", drives)


def test_inventory_of_real_files(store, drives):
    files = {r.file_name: r for r in store.entries().filter("entry_type = 'F'").collect()}
    assert files["a.mp3"].content_hash == hashlib.sha256(b"aaaa").hexdigest()
    assert files["a.mp3"].size_bytes == 4
    assert len(files) == 6
    folders = {r.full_path.split(":")[1]: r for r in store.entries().filter("entry_type = 'D'").collect()}
    assert folders[f"{drives[0]}/music"].content_hash == folders[f"{drives[1]}/copy"].content_hash
    runs = {r.drive: r for r in store.scans().collect()}
    assert {(r.status, r.files_written, r.compute_hash) for r in runs.values()} == {(S.COMPLETED, 3, True)}
    assert all(r.completed_at_utc >= r.started_at_utc for r in runs.values())


def test_batch_names_are_used_once(spark, store, drives):
    with pytest.raises(ValueError, match="already holds"):
        inventory_of_roots(spark, store.base, "b1", drives)
    assert store.entries().filter("entry_type = 'F'").count() == 6


def test_roots_with_and_without_a_separator_are_one_drive(spark, store, drives):
    inventory_of_roots(spark, store.base, "b2", [drives[0] + "/"])
    assert top_duplicates(store.entries(), store.scans(), drives=drives[:1]).scans.count() == 1


def test_top_duplicates_of_real_files(store):
    top = top_duplicates(store.entries(), store.scans(), n=5, k=1)
    assert [r.wasted_bytes for r in top.file_sets.orderBy(F.desc("wasted_bytes")).collect()] == [4, 2]
    assert top.total.first()[0] == 6
    folder = top.folder_sets.first()
    assert (folder.copy_count, folder.wasted_bytes, folder.distinct_name_count) == (2, 6, 2)
    assert top.folder_locations.count() == 1
    assert top.scans.count() == 2


def test_analysis_of_one_drive_only(spark, tmp_path):
    frame = listed(spark, [("s3://a/", "s3://a/x", "h1"), ("s3://b/", "s3://b/y", "h1")])
    store = inventory_of_listing(spark, str(tmp_path / "i"), "b", frame)
    assert top_duplicates(store.entries(), store.scans()).file_sets.count() == 1
    assert top_duplicates(store.entries(), store.scans(), drives=["s3://a"]).file_sets.count() == 0


def listed(spark, rows, size=10):
    frame = spark.createDataFrame(rows, "root string, full_path string, label string")
    return frame.select(
        "root", "full_path", F.element_at(F.split("full_path", "/"), -1).alias("file_name"),
        F.lit(size).cast("long").alias("size_bytes"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("date_modified_utc"),
        F.lit(None).cast("timestamp_ntz").alias("date_created_utc"),
        F.sha2("label", 256).alias("content_hash"),
    )


def test_no_completed_run(spark, tmp_path):
    empty = Inventory(spark, str(tmp_path / "none"))
    with pytest.raises(NoCompletedRun):
        top_duplicates(empty.entries(), empty.scans())
    report = duplicates_over(empty.entries(), empty.scans(), 0)
    assert report.file_sets.isEmpty() and report.total.first()[0] == 0
    lines = in_report_order(yaml_lines(report, 0, utc_now())).collect()
    assert [r.line for r in lines[1:]] == ["scans: []", "duplicateFileSets: []", "duplicateFolderSets: []"]
    with pytest.raises(NoCompletedRun):
        cleanup_plan(empty.entries(), empty.skips(), empty.scans())
    with pytest.raises(NoCompletedRun):
        cleanup_execute(empty, str(tmp_path / "out"))


def test_report_text_in_order(spark, store, tmp_path):
    out = tmp_path / "report"
    write_report(duplicates_over(store.entries(), store.scans(), 3), str(out), 3, utc_now())
    text = "".join(p.read_text() for p in sorted((out / "report.yml").glob("part-*")))
    assert text.index("scans:") < text.index("duplicateFileSets:") < text.index("duplicateFolderSets:")
    files = text[text.index("duplicateFileSets:"):text.index("duplicateFolderSets:")]
    assert files.count("  - name:") == 1 and files.count("      - ") == 2
    assert '  - name: null\n    namesDiffer: true' in files
    assert files.index("music/a.mp3") < files.index("copy/x.mp3")
    assert "totalWastedBytes: 6" in text and "wastedSpaceThresholdBytes: 3" in text
    sets = [json.loads(line) for p in (out / "sets").glob("part-*") for line in p.read_text().splitlines()]
    assert sorted((s["section"], s["wasted_bytes"]) for s in sets) == [("files", 4), ("folders", 6)]


def test_superseded_runs_are_cleaned_up_once(spark, store, drives, tmp_path):
    again = inventory_of_roots(spark, store.base, "b2", drives[:1])
    assert again.scans().count() == 3
    before = again.entries().count()
    target = str(tmp_path / "clean")
    assert cleanup_execute(again, target, dry_run=True).written is False
    result = cleanup_execute(again, target)
    clean = Inventory(spark, target)
    assert result.files_deleted == before - clean.entries().count() > 0
    assert clean.scans().count() == 3
    assert cleanup_execute(clean, str(tmp_path / "twice")).written is False


def test_cleanup_in_place_changes_versions_at_once(spark, store, drives, monkeypatch):
    again = inventory_of_roots(spark, store.base, "b2", drives[:1])
    before, open_reader = again.entries().count(), again.entries()
    assert cleanup_in_place(again, dry_run=True).written is False

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as patch:
        patch.setattr(Inventory, "commit_dropped", crash)
        with pytest.raises(RuntimeError):
            cleanup_in_place(again)
    assert again.entries().count() == before
    result = cleanup_in_place(again)
    after = again.entries().count()
    assert result.written and result.files_deleted == before - after > 0
    # A frame made before the cleanup still sees the version it was made from.
    assert open_reader.count() == before
    assert cleanup_in_place(again).written is False
    assert [len(again._commits()), again.scans().count()] == [1, 3]
    third = inventory_of_roots(spark, store.base, "b3", drives[1:])
    assert cleanup_in_place(third).written and len(third._commits()) == 2
    kept = {r.scan_run_id for r in latest_runs(third.scans()).collect()}
    assert {r[0] for r in third.entries().select("scan_run_id").distinct().collect()} == kept
    rows = sorted(map(str, third.entries().collect()))
    third.vacuum()
    assert sorted(map(str, third.entries().collect())) == rows
    folders = {p.name.removeprefix("scan_run_id=") for p in Path(store.base, "entries").glob("scan_run_id=*")}
    assert folders == kept


def test_a_version_is_never_replaced(spark, store, monkeypatch):
    runs = store.scans().select("scan_run_id").limit(1)
    store.commit_dropped(runs)
    # Another cleanup that has not seen the first one.
    monkeypatch.setattr(Inventory, "_commits", lambda _: [])
    with pytest.raises(Exception, match="exist"):
        store.commit_dropped(runs)


def test_locations_of_few_sets_skip_row_groups(spark, tmp_path):
    n = 30_000
    rows = spark.range(n).select(
        F.lit("r").alias("scan_run_id"), F.lit("F").alias("entry_type"), F.concat(F.lit("/f"), "id").alias("full_path"),
        F.lit(1).alias("size_bytes"), F.sha2((F.col("id") / 2).cast("int").cast("string"), 256).alias("content_hash"),
    )
    store = Inventory(spark, str(tmp_path / "i"))
    store.create()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "65536")
    try:
        store.write_entries(rows)
    finally:
        conf.unset("parquet.block.size")
    sets = spark.createDataFrame([(hashlib.sha256(str(i).encode()).hexdigest(), 1) for i in (5, 77)], "content_hash string, size_bytes bigint")
    found = D.of_chosen(store.entries(), sets)
    assert sorted(r.full_path for r in found.collect()) == ["/f10", "/f11", "/f154", "/f155"]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < n / 4
    assert D.of_chosen(store.entries(), sets, most=1).count() == n


def test_managed_tables_are_cleaned_up_in_place(spark, store, drives):
    again = inventory_of_roots(spark, store.base, "it's 2", drives[:1])
    for name, rows, by in [
        ("kept_entries", again.entries(), ["scan_run_id", "entry_type"]), ("kept_skips", again.skips(), ["scan_run_id"]),
    ]:
        rows.write.partitionBy(*by).saveAsTable(name)
    scans = stage(again.scans(), "scans")
    assert cleanup_tables(spark, "kept_entries", "kept_skips", scans, dry_run=True).written is False
    before = spark.table("kept_entries").count()
    result = cleanup_tables(spark, "kept_entries", "kept_skips", scans)
    after = spark.table("kept_entries").select("scan_run_id").distinct().collect()
    assert result.files_deleted == before - spark.table("kept_entries").count() > 0
    assert {r[0] for r in after} == {r.scan_run_id for r in latest_runs(scans).collect()}
    assert cleanup_tables(spark, "kept_entries", "kept_skips", scans).files_deleted == 0
    spark.sql("drop table kept_entries")
    spark.sql("drop table kept_skips")


def test_limits_and_switches(spark, drives, tmp_path):
    limited = InventoryOptions(max_hash_bytes=2)
    rows = inventory_of_roots(spark, str(tmp_path / "i1"), "b", drives, limited).entries()
    big = rows.filter("entry_type = 'F' and size_bytes > 2")
    assert big.filter("content_hash is null and scan_error is null").count() == big.count() == 2
    assert rows.filter("entry_type = 'F' and size_bytes <= 2 and content_hash is null").count() == 0
    plain = InventoryOptions(compute_hash=False)
    rows = inventory_of_roots(spark, str(tmp_path / "i2"), "b", drives, plain).entries()
    assert (rows.count(), rows.filter("content_hash is not null").count()) == (6, 0)
    staged = InventoryOptions(compute_folders=False)
    rows = inventory_of_roots(spark, str(tmp_path / "i3"), "b", drives, staged).entries()
    assert (rows.count(), rows.filter("content_hash is not null").count()) == (6, 6)


def test_recreate_keeps_the_log(spark, store, drives):
    again = inventory_of_roots(
        spark, store.base, "b2", drives[:1], InventoryOptions(recreate=True, compute_folders=False)
    )
    assert (again.entries().count(), again.scans().count()) == (3, 3)


def test_missing_root_is_skipped(spark, drives, tmp_path):
    roots = [drives[0], str(tmp_path / "absent")]
    found = inventory_of_roots(spark, str(tmp_path / "i"), "b", roots)
    assert found.skips().select("full_path").collect() == [(roots[1],)]
    assert found.skips().first().reason.startswith("FileNotFoundError: ")
    assert {r.files_written for r in found.scans().collect()} == {3, 0}


@pytest.mark.parametrize(
    ("raised", "status", "error"),
    [(ValueError("disk gone"), S.FAILED, "disk gone"), (KeyboardInterrupt(), S.CANCELED, None)],
)
def test_interrupted_runs_are_logged(spark, drives, tmp_path, monkeypatch, raised, status, error):
    def broken(*_):
        raise raised

    monkeypatch.setattr(I, "folder_rows", broken)
    with pytest.raises(type(raised)):
        inventory_of_roots(spark, str(tmp_path / "i"), "b", drives)
    found = Inventory(spark, str(tmp_path / "i"))
    assert {(r.status, r.scan_error, r.files_written) for r in found.scans().collect()} == {(status, error, 3)}
    with pytest.raises(NoCompletedRun):
        top_duplicates(found.entries(), found.scans())


def test_files_that_vanish_have_an_error(spark, drives):
    listing = L.read_listings(spark, drives).files
    hashes = {r.full_path: r.content_hash for r in L.hash_results(listing).collect()}
    assert len(hashes) == 6
    assert hashes[f"file:{drives[0]}/note.txt"] == hashlib.sha256(b"n").hexdigest()
    Path(drives[0], "note.txt").unlink()
    gone = [r for r in L.hash_results(listing).collect() if r.full_path.endswith("note.txt")]
    assert len(gone) == 1 and gone[0].content_hash is None
    assert gone[0].error.startswith("FileNotFoundError: ")


def test_paths_of_stores():
    assert storage.place_of("s3a://b/k e%y#1") == ("s3:", "b/k e%y#1")
    assert storage.place_of("hdfs://nn:8020/a b") == ("hdfs://nn:8020/", "/a b")
    assert storage.local_name("dbfs:/x/y") == "/dbfs/x/y"
    assert storage.local_name("file:/x #%20") == "/x #%20"
    assert storage.local_name("s3a://b/k") is None


def test_whole_chain(spark, store, tmp_path):
    options = ChainOptions(
        report_to=str(tmp_path / "reports"), report_threshold_bytes=0, cleanup_to=str(tmp_path / "clean")
    )
    result = after_inventory(store, True, options)
    assert result.analysis.folder_sets.count() == 1
    assert Path(result.report_path, "report.yml", "_SUCCESS").exists()
    assert result.cleanup.written is False
    assert after_inventory(store, False, options).analysis is None
    assert after_inventory(Inventory(spark, str(tmp_path / "none")), True, options).analysis is None
