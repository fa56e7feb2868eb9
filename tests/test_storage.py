"""Listing and hashing real files: names, links, failures, outcomes by root, stopping and going on."""

import hashlib
import os
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from echofold import schemas as S
from echofold.plans import inventory as I
from echofold.plans.inventory import InventoryOptions, inventory_of_roots, resume_inventory
from echofold.sources import listing as L
from echofold.sources import storage
from echofold.sources.store import Inventory
from verification import fixtures


def write(root, names):
    for name in names:
        file = Path(root, name)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(str(name))


def listed(spark, roots, follow_links=False):
    """Paths beneath the first root's parent, each as often as it is listed."""
    top = f"file:{Path(roots[0]).parent}/"
    found = L.read_listings(spark, [str(r) for r in roots], follow_links)
    return sorted(r.full_path.removeprefix(top) for r in found.files.collect())


def test_names_and_links(spark, tmp_path):
    root = tmp_path / "top"
    names = ["a.txt", ".hidden", "_under", ".git/config", "_delta_log/0 #%20.json", "sub/c.txt"]
    write(root, names)
    Path(root, "link.txt").symlink_to(root / "a.txt")
    Path(root, "broken").symlink_to(root / "nothing")
    Path(root, "itself").symlink_to(root / "itself")
    Path(root, "linked").symlink_to(root / "sub")
    Path(root, "loop").symlink_to(root)
    expected = sorted(f"top/{name}" for name in names)
    assert listed(spark, [root]) == expected
    # Links to files stay out; folders that were met already are not entered again.
    assert listed(spark, [root], True) == expected
    hashed = L.hash_results(L.read_listing(spark, str(root))).collect()
    assert len(hashed) == 6 and not any(r.error for r in hashed)


def test_links_in_a_circle_list_each_file_once(spark, tmp_path):
    root = tmp_path / "top"
    write(root, [f"{folder}/{i}.txt" for folder in ("one", "two/deep") for i in range(4)])
    Path(root, "one/to_two").symlink_to(root / "two")
    Path(root, "two/deep/to_one").symlink_to(root / "one")
    Path(root, "two/self").symlink_to(root / "two/deep")
    assert listed(spark, [root], True) == sorted(f"top/{f}/{i}.txt" for f in ("one", "two/deep") for i in range(4))


def test_folders_that_only_links_lead_to(spark, tmp_path):
    root, outside = tmp_path / "top", tmp_path / "outside"
    write(root, ["photos2/a.txt", "photos/b.txt"])
    write(outside, ["x.txt", "in/y.txt"])
    # A sibling whose name begins alike is no ancestor.
    Path(root, "photos2/to").symlink_to(root / "photos")
    Path(root, "z_first").symlink_to(outside)
    Path(root, "also").symlink_to(outside)
    Path(outside, "in/back").symlink_to(root)
    Path(outside, "further").symlink_to(outside / "in")
    assert listed(spark, [root]) == ["top/photos/b.txt", "top/photos2/a.txt"]
    assert listed(spark, [root], True) == [
        "top/also/in/y.txt", "top/also/x.txt", "top/photos/b.txt", "top/photos2/a.txt",
    ]


def test_overlapping_roots_are_kept_apart_when_following(spark, tmp_path):
    root = tmp_path / "top"
    write(root, ["a.txt", "sub/b.txt"])
    Path(root, "sub/up").symlink_to(root)
    assert listed(spark, [root, root / "sub"], True) == [
        "top/a.txt", "top/sub/b.txt", "top/sub/b.txt", "top/sub/up/a.txt",
    ]


@pytest.mark.parametrize("name", [b"n\xff", b"\xffolder/\xfe\x80 x.txt", "é 日".encode(), "\uef80x\uefff".encode(), b"\xed\xa0\x80"])
def test_any_name_is_listed_and_read(spark, tmp_path, name):
    root = os.fsencode(tmp_path) + b"/top"
    path = root + b"/" + name
    os.makedirs(os.path.dirname(path), exist_ok=True)
    Path(os.fsdecode(path)).write_bytes(b"content")
    (row,) = L.hash_results(L.read_listing(spark, str(tmp_path / "top"))).collect()
    assert row.content_hash == hashlib.sha256(b"content").hexdigest()
    assert storage.bytes_of(storage.local_name(row.full_path)) == path


def test_names_as_text_and_back():
    for name in [b"plain", b"\x80\xff", "\uef00\uef80\uefff\uf000".encode(), bytes(range(1, 256))]:
        text = storage.text_of(name)
        assert storage.bytes_of(text) == name
        text.encode("utf-8")
    assert storage.text_of("é日".encode()) == "é日"


class Entry:
    def __init__(self, name, fails=None):
        self.name, self.path, self.fails = name, b"/t/" + name, fails

    def is_symlink(self):
        return False

    def is_dir(self):
        return self.name.startswith(b"d")

    def stat(self, follow_symlinks=True):
        if self.fails:
            raise self.fails
        return os.stat("/")


def test_an_entry_that_cannot_be_read_loses_its_own_row_only(monkeypatch):
    class Found(list):
        __enter__, __exit__ = (lambda self: self), (lambda self, *_: None)

    entries = Found([Entry(b"a"), Entry(b"b", PermissionError()), Entry(b"c"), Entry(b"d", PermissionError())])
    monkeypatch.setattr(os, "scandir", lambda folder: entries)
    found = list(storage._children("/t"))
    assert [(row[0], row[1]) for row in found] == [("/t/a", False), ("/t/c", False), ("/t/d", True)]


def test_a_folder_that_cannot_be_listed_is_one_row(monkeypatch):
    def failing(folder):
        if folder.endswith("secret"):
            raise PermissionError("denied")
        if folder.endswith("strange"):
            raise ValueError("no such store")
        yield f"{folder}/f", False, False, None, 1, None

    monkeypatch.setattr(storage, "_children", failing)
    folders = pd.DataFrame({"root": ["r"] * 3, "full_path": ["r/open", "r/secret", "r/strange"]})
    rows = pd.concat(storage.list_folders([folders]))
    assert rows["full_path"].tolist() == ["r/open/f", "r/secret", "r/strange"]
    assert rows["list_error_type"].tolist() == [None, "PermissionError", "ValueError"]
    assert rows["is_fatal"].tolist() == [False, False, True]


# --- outcomes, stopping and going on ---


def drives_in(top):
    write(top / "d1", [f"f{i}/{j}.txt" for i in range(4) for j in range(5)])
    write(top / "d2", ["x.txt", "y/z.txt"])
    return [str(top / "d1"), str(top / "d2")]


@pytest.fixture
def drives(tmp_path):
    return drives_in(tmp_path)


def state(store, top):
    """All entries, with paths beneath the test's folder and without what names it."""
    rows = store.entries().filter(F.startswith("full_path", F.lit(f"file:{top}/"))).collect()
    return sorted((r.entry_type, r.full_path.removeprefix(f"file:{top}"), r.size_bytes, str(r.content_hash)) for r in rows)


@pytest.fixture(scope="module")
def undisturbed(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("undisturbed")
    store = inventory_of_roots(spark, str(top / "i"), "b", drives_in(top), InventoryOptions(bucket_bytes=60))
    return state(store, top)


def test_roots_have_outcomes_of_their_own(spark, tmp_path, drives):
    roots = [*drives, "nostore://bucket/x", str(tmp_path / "absent")]
    store = inventory_of_roots(spark, str(tmp_path / "i"), "b", roots)
    outcome = {r.roots: (r.status, r.files_written, (r.scan_error or "")[:12]) for r in store.scans().collect()}
    assert outcome == {
        drives[0]: (S.COMPLETED, 20, ""), drives[1]: (S.COMPLETED, 2, ""),
        "nostore://bucket/x": (S.FAILED, 0, "ArrowInvalid"), str(tmp_path / "absent"): (S.COMPLETED, 0, ""),
    }
    assert {r.full_path for r in store.skips().collect()} == {"nostore://bucket/x", str(tmp_path / "absent")}
    assert store.entries().filter("entry_type = 'D' and content_hash is null").isEmpty()


@pytest.mark.parametrize("stop_at", ["listing", 1, "merge", "folders"])
def test_a_stopped_inventory_goes_on_where_it_stopped(spark, tmp_path, drives, monkeypatch, undisturbed, stop_at):
    options = InventoryOptions(bucket_bytes=60)

    def stop(*_, **__):
        raise KeyboardInterrupt

    base = str(tmp_path / "stopped")
    with monkeypatch.context() as patch:
        if stop_at == "listing":
            patch.setattr(Inventory, "write_failures", stop)
        elif stop_at == "merge":
            patch.setattr(I, "merge_hashes", stop)
        elif stop_at == "folders":
            patch.setattr(I, "folder_rows", stop)
        else:
            mark = Inventory.write_progress
            patch.setattr(
                Inventory, "write_progress",
                lambda store, batch, step, number: stop() if (step, number) == (S.HASHED, stop_at) else mark(store, batch, step, number),
            )
        with pytest.raises(KeyboardInterrupt):
            inventory_of_roots(spark, base, "b", drives, options)
    store = Inventory(spark, base)
    assert {r.status for r in store.scans().collect()} == {S.CANCELED}
    if stop_at != "listing":
        assert store.entries().filter("entry_type = 'F'").count() == 22
    done = {r.full_path for r in store.hashes("b").collect()}
    assert (len(done) == 22) == (stop_at in ("merge", "folders")) and bool(done) == (stop_at != "listing")
    # Files of finished buckets are not read again: they may be gone by now.
    for path in done:
        os.remove(path.removeprefix("file:"))
    resumed = resume_inventory(spark, base, "b", options)
    assert state(resumed, tmp_path) == undisturbed
    assert {r.status for r in resumed.scans().collect()} == {S.COMPLETED}
    with pytest.raises(ValueError, match="left to finish"):
        resume_inventory(spark, base, "b", options)


def test_many_small_buckets_are_hashed_in_few_jobs(spark, tmp_path, drives, monkeypatch):
    monkeypatch.setattr(I, "_MOST_ROUNDS", 2)
    written, marked = [], []
    write, mark = Inventory.write_hashes, Inventory.write_progress
    monkeypatch.setattr(Inventory, "write_hashes", lambda *a: written.append(1) or write(*a))
    monkeypatch.setattr(
        Inventory, "write_progress", lambda s, b, step, *n: marked.extend(n if step == S.HASHED else ()) or mark(s, b, step, *n)
    )
    store = inventory_of_roots(spark, str(tmp_path / "i"), "b", drives, InventoryOptions(bucket_bytes=10))
    assert len(written) == 2 and sorted(marked) == list(range(len(marked))) and len(marked) > 4
    assert store.entries().filter("entry_type = 'F' and content_hash is not null").count() == 22


def test_tasks_that_write_contents_hold_few_rows_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"rows": [len(batch)]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with fixtures.few_rows_a_batch(spark):
        rows = [r.rows for r in spark.range(1_000, numPartitions=1).mapInPandas(sizes, "rows long").collect()]
    assert max(rows) <= 100 and sum(rows) == 1_000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
