import pytest

from echofold.operators.duplicates import duplicate_sets, locations, sample_locations
from echofold.operators.folders import folder_rows
from echofold.operators.prune import prune_folders
from tests.trees import files

SUB = {"P/a/f": "h1", "P/g": "h2", "Q/a/f": "h1", "Q/g": "h2"}

CASES = {
    "single-child chain": ({"A/x/y/f": "h1", "B/x/y/f": "h1"}, [{"A", "B"}]),
    "sub-tree of a larger set": (SUB, [{"P", "Q"}]),
    "partly covered": ({**SUB, "R/a/f": "h1", "R/k": "h9"}, [{"P", "Q"}, {"P/a", "Q/a", "R/a"}]),
    "covered by two sets only together": (
        {**SUB, "U/a/f": "h1", "U/w": "h3", "V/a/f": "h1", "V/w": "h3"},
        [{"P", "Q"}, {"U", "V"}, {"P/a", "Q/a", "U/a", "V/a"}],
    ),
    "two copies inside each larger copy": (
        {"P/a/f": "h1", "P/b/f": "h1", "Q/a/f": "h1", "Q/b/f": "h1"}, [{"P", "Q"}],
    ),
    "tainted": ({**SUB, "Q/g": None}, [{"P/a", "Q/a"}]),
    "same hash, different size": ({"P/f": ("h1", 10), "Q/f": ("h1", 20)}, []),
    "other nesting and names": ({"P/a/f": "h1", "P/b/g": "h2", "Q/z/k": "h2", "Q/m": "h1"}, [{"P", "Q"}]),
    "copies counted": ({"P/f": "h1", "P/g": "h1", "Q/f": "h1"}, []),
}


@pytest.mark.parametrize("case", CASES)
def test_only_top_most_redundant_trees_remain(spark, case):
    tree, expected = CASES[case]
    pruned = prune_folders(folder_rows(files(spark, tree)))
    found = {}
    for row in locations(pruned.independent, pruned.sets()).collect():
        found.setdefault(row.content_hash, set()).add(row.full_path.removeprefix("s3://b/"))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected))


def test_a_covered_set_stays_hidden_below_the_floor_of_its_cover(spark):
    pruned = prune_folders(folder_rows(files(spark, SUB)))
    assert pruned.sets(21).count() == 0
    assert [r.wasted_bytes for r in pruned.sets(20).collect()] == [20]


def test_empty_files_form_a_set_that_wastes_nothing(spark):
    rows = files(spark, {"a": ("", 0), "b": ("", 0)})
    assert [(r.copy_count, r.wasted_bytes) for r in duplicate_sets(rows).collect()] == [(2, 0)]
    assert duplicate_sets(rows, 1).count() == 0


def test_sample_set_wastes_all_but_one_copy(spark):
    size = 1073741824
    rows = files(spark, {f"{d}/v.mp4": ("video", size) for d in "abc"})
    found = duplicate_sets(rows).first()
    assert (found.copy_count, found.wasted_bytes, found.distinct_name_count) == (3, 2147483648, 1)


@pytest.mark.parametrize("k", [1, 2, 1_001])
def test_samples_deal_the_copies_once(spark, k):
    frame = files(spark, {**{f"P/{i}": "h1" for i in range(5)}, "Q/a": "h1", "Q/b": "h2", "R/b": "h2", "R/c": "h3", "R/d": None})
    found = sample_locations(frame, duplicate_sets(frame), k)
    paths = {"h1": [*[f"P/{i}" for i in range(5)], "Q/a"], "h2": ["Q/b", "R/b"]}
    expected = [(f"s3://b/{p}", n) for all_paths in paths.values() for n, p in enumerate(all_paths[:k], 1)]
    assert sorted((r.full_path, r.position) for r in found.collect()) == sorted(expected)
    if k <= 1_000:
        plan = found._jdf.queryExecution().executedPlan().toString()
        before = plan.index("WindowGroupLimit [packed")
        # Cut before and after the one exchange that carries paths, with no join in between.
        ranked = plan[plan.index("Window [row_number"):plan.index("Scan", before)]
        assert ranked.count("Exchange hashpartitioning") == 1 and ranked.count("WindowGroupLimit") == 2
        assert "Join" not in ranked


def test_folder_sets_compare_packed_hashes(spark):
    pruned = prune_folders(folder_rows(files(spark, SUB)))
    assert pruned.kept.schema["content_hash"].dataType.simpleString() == "string"
    staged = [f for f in pruned.kept.inputFiles() if "/set-members-" in f]
    assert spark.read.parquet(*staged).schema["content_hash"].dataType.simpleString() == "binary"
