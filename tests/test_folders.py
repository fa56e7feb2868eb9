import hashlib
import struct
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofold.operators import folders
from echofold.operators.folders import folder_rows
from tests.trees import digest, files
from verification.queries import REGISTRY


def tree_of(hashes):
    """Leaves of four hex digits, inner nodes of two, and the root with the number of files."""
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    leaves = defaultdict(str)
    for content, copies in sorted(Counter(hashes).items()):
        leaves[content[:4]] += f"{content}:{copies},"
    nodes = defaultdict(str)
    for leaf, counted in sorted(leaves.items()):
        nodes[leaf[:2]] += sha(counted)
    joined = b"".join(bytes.fromhex(sha(nodes[node])) for node in sorted(nodes))
    return hashlib.sha256(joined + struct.pack("<q", len(hashes))).hexdigest()


def expected_fingerprints(rows):
    """Plain hashlib over each folder's descendants."""
    beneath = defaultdict(list)
    for row in rows:
        folder = row.full_path.rsplit("/", 1)[0]
        while True:
            at_root = folder.count("/") == 2
            beneath[folder + "/" if at_root else folder].append(row.content_hash)
            if at_root:
                break
            folder = folder.rsplit("/", 1)[0]
    found = {}
    for folder, hashes in beneath.items():
        found[folder] = None if None in hashes else tree_of(hashes)
    return found


def fingerprints(frame):
    return {r.full_path: r.content_hash for r in folder_rows(frame).collect()}


TREE = {
    "P/a/f": "h1", "P/a/g": "h1", "P/b/f": "h1", "P/b/k": "h2", "Q/z/k": "h2", "Q/m": "h1", "Q/n": "h1", "Q/o": "h1",
    "T/a": "h3", "T/x/b": None, "one/f": "h1",
}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_fingerprints_match_hashlib_however_rows_are_dealt(spark, parts):
    frame = files(spark, TREE).repartition(int(parts))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert fingerprints(frame) == expected_fingerprints(frame.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_folder_of_many_leaves_matches_hashlib(spark):
    frame = files(spark, {f"many/{i % 3}/{i}": f"h{i // 2}" for i in range(1_500)})
    assert fingerprints(frame) == expected_fingerprints(frame.collect())


def test_names_and_nesting_do_not_matter_but_copies_do(spark):
    found = fingerprints(files(spark, {**TREE, "R/m": "h1", "R/n": "h1", "R/k": "h2"}))
    assert found["s3://b/P"] == found["s3://b/Q"]
    assert found["s3://b/P"] != found["s3://b/R"]


def test_unhashed_file_taints_every_folder_above(spark):
    rows = {r.full_path: r for r in folder_rows(files(spark, TREE)).collect()}
    assert all(rows[p].content_hash is None for p in ["s3://b/T/x", "s3://b/T", "s3://b/"])
    assert rows["s3://b/T"].size_bytes == 20
    assert rows["s3://b/"].file_name == "s3://b/"
    assert rows["s3://b/T/x"].file_name == "x"


def test_runs_are_kept_apart(spark):
    both = files(spark, {"P/a": "h1"}, run="r1").unionAll(files(spark, {"P/a": "h2"}, run="r2"))
    rows = {(r.scan_run_id, r.full_path): r.content_hash for r in folder_rows(both).collect()}
    one = tree_of([digest("h1")])
    assert rows["r1", "s3://b/P"] == one != rows["r2", "s3://b/P"]


names = st.sampled_from(["a", "b", "c"])
tree = st.dictionaries(
    st.lists(names, min_size=1, max_size=4).map(lambda parts: "/".join(["d", *parts, "f"])),
    st.sampled_from(["h1", "h2", "h3", None]), max_size=12,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(tree, st.randoms())
def test_any_tree_matches_hashlib_in_any_row_order(spark, tree, random):
    paths = list(tree)
    random.shuffle(paths)
    frame = files(spark, {path: tree[path] for path in paths})
    assert fingerprints(frame) == expected_fingerprints(frame.collect())


def test_fingerprints_of_repeated_folders_only(spark):
    frame = files(spark, {**TREE, "R/m": "h1", "R/n": "h1", "R/k": "h2"})
    whole, some = fingerprints(frame), {r.full_path: r for r in folder_rows(frame, repeated_only=True).collect()}
    assert some.keys() == whole.keys()
    counts = Counter(whole.values())
    for path, value in whole.items():
        # Every folder that has an equal one keeps its value; the others have it or none.
        assert some[path].content_hash == value if counts[value] > 1 else some[path].content_hash in (value, None)
    assert some["s3://b/one"].content_hash is None


def test_equal_summaries_do_not_make_equal_folders(spark, monkeypatch):
    # Two contents whose sums agree: all lanes are the same number.
    monkeypatch.setattr(folders, "_lane", lambda number: F.lit(1).cast("bigint"))
    rows = {r.full_path: r.content_hash for r in folder_rows(files(spark, {"A/x": "h1", "B/x": "h2"}), True).collect()}
    assert rows["s3://b/A"] == tree_of([digest("h1")]) != rows["s3://b/B"]


@pytest.mark.parametrize("rows_in_a_batch", ["2", "10000"])
def test_chains_go_on_across_batches(spark, monkeypatch, rows_in_a_batch):
    monkeypatch.setattr(folders, "_CHAIN_COPIES", 3)
    frame = files(spark, {**TREE, **{f"many/{i % 3}/{i}": f"h{i // 8}" for i in range(200)}})
    beneath = defaultdict(list)
    for row in frame.collect():
        parts = row.full_path.removeprefix("s3://").split("/")
        for depth in range(1, len(parts)):
            name = "s3://" + "/".join(parts[:depth]) + ("/" if depth == 1 else "")
            beneath[name].append(row.content_hash)
    expected = {
        name: hashlib.sha256(bytes.fromhex("".join(sorted(hashes))) + len(hashes).to_bytes(8, "little")).hexdigest()
        for name, hashes in beneath.items() if None not in hashes
    }
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_in_a_batch)
    try:
        assert {r.full_path: r.chain_hash for r in folders.chain_hashes(frame).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_summaries_add_up(spark):
    frame = files(spark, TREE).filter("content_hash is not null")
    rows = {r.full_path: r for r in folders.folder_rollup(frame, summarize=True).collect()}
    for lane in folders.LANES:
        parts = [rows[f"s3://b/{p}"][lane] for p in ("P", "Q", "T", "one")]
        assert rows["s3://b/"][lane] == sum(parts) + int(digest("alone")[6 * int(lane[-1]) :][:6], 16)
    assert rows["s3://b/P"][folders.LANES[0]] == rows["s3://b/Q"][folders.LANES[0]]  # h1 x 3 and h2


def exchanges(frame):
    return [line for line in planned(frame).splitlines() if " Exchange hashpartitioning" in line]


def planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_copies_for_ancestors_are_made_after_the_contents_are_dealt(spark):
    """No join with lineage, and no exchange below a copy: own folder, leaf, folder; two for the roll-up."""
    rows = folder_rows(files(spark, TREE))
    assert len(exchanges(rows)) == 5
    leaves = planned(folders._leaves(files(spark, TREE)))
    assert leaves.index("Generate explode") < leaves.index("Exchange hashpartitioning(leaf")


def test_a_chain_deals_its_contents_twice_and_joins_nothing(spark):
    """Once to count them in their own folder, once by the folder that digests them."""
    chains = folders.chain_hashes(files(spark, TREE))
    assert len(exchanges(chains)) == 2 and "Join" not in planned(chains)
    found = {r.full_path: r.chain_hash for r in chains.collect()}
    # What is above a file without a hash has no chain, what lies beside it has.
    assert "s3://b/P" in found and not {"s3://b/T", "s3://b/T/x", "s3://b/"} & set(found)


def test_chains_of_a_table_read_once_write_no_copy_of_it(spark, tmp_path):
    row = "1L as l_orderkey, 2L as l_partkey, 3L as l_suppkey, 4 as l_linenumber, 5.0D as l_quantity, 'R' as l_returnflag"
    spark.sql(f"select {row}, timestamp_ntz'1996-04-01 00:00:00' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    chains = REGISTRY["lineitem_folders_chained"](spark, str(tmp_path))
    assert {f.rsplit("/", 2)[-2] for f in chains.inputFiles()} == {"lineitem.parquet"}
    content = hashlib.sha256(b"2|5").digest()
    chain = hashlib.sha256(content + struct.pack("<q", 1)).hexdigest()
    folders_above = ["s3://r/", "s3://r/1996", "s3://r/1996/4", "s3://r/1996/4/o1"]
    assert sorted((r.full_path, r.chain_hash) for r in chains.collect()) == [(f, chain) for f in folders_above]


def test_only_wanted_folders_are_copied_before_contents_are_dealt(spark):
    frame = files(spark, TREE)
    wanted = folders.folder_rollup(frame).filter("full_path like '%/P/a'")
    leaves = {r.full_path for r in folders._leaves(frame, wanted).collect()}
    assert leaves == {"s3://b/P/a"}
    assert {r.full_path for r in folders.fingerprints(frame, wanted).collect()} == {"s3://b/P/a"}
