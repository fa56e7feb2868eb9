from datetime import datetime

import pytest

from echofold import schemas as S
from echofold.operators import runs as R
from echofold.operators.summary import hash_coverage, merge_hashes
from echofold.staging import stage
from tests.trees import files


def scans(spark, rows):
    frame = spark.createDataFrame(
        rows, "scan_run_id string, drive string, status string, completed_at_utc timestamp_ntz"
    )
    return frame


DAY = [datetime(2024, 1, d) for d in range(1, 6)]


def test_newest_completed_run_of_each_drive(spark):
    log = scans(spark, [
        ("old", "C:\\", S.COMPLETED, DAY[0]), ("new", "C:\\", S.COMPLETED, DAY[1]),
        ("canceled", "C:\\", S.CANCELED, DAY[3]), ("running", "C:\\", S.RUNNING, None),
        ("tie-b", "D:\\", S.COMPLETED, DAY[2]), ("tie-a", "D:\\", S.COMPLETED, DAY[2]),
        ("no-drive", None, S.COMPLETED, DAY[4]),
    ])
    found = {r.drive: r.scan_run_id for r in R.latest_runs(log).collect()}
    assert found == {"C:\\": "new", "D:\\": "tie-a"}
    only = R.latest_runs(log, R.canonical_drives(log, ["d"])).collect()
    assert [r.scan_run_id for r in only] == ["tie-a"]
    assert [r.scan_run_id for r in R.incomplete_runs(log).collect()] == ["running"]


def test_rank_is_limited_before_the_shuffle(spark):
    """A drive with most of the runs sends one row per task."""
    log = scans(spark, [("a", "C:\\", S.COMPLETED, DAY[0])])
    plan = R.latest_runs(log)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize(
    ("statuses", "worst"),
    [([S.COMPLETED], (S.COMPLETED, 0)), ([S.COMPLETED, S.CANCELED], (S.CANCELED, 130)),
     ([S.CANCELED, S.FAILED, S.COMPLETED], (S.FAILED, 1)), ([S.COMPLETED, S.RUNNING], (S.COMPLETED, 0))],
)
def test_worst_outcome(spark, statuses, worst):
    log = scans(spark, [(str(i), "C:\\", s, None) for i, s in enumerate(statuses)])
    assert tuple(R.batch_outcome(log).first()) == worst


def test_hash_results_are_merged_without_clobbering_errors(spark):
    listed = files(spark, {"a": None, "b": None, "c": None, "d": "old"})
    listed = listed.selectExpr("* except (scan_error)", "if(file_name = 'b', 'first', null) as scan_error")
    results = spark.createDataFrame(
        [("r", "s3://b/a", "H", None), ("r", "s3://b/b", None, "second"), ("r", "s3://b/c", None, None)],
        "scan_run_id string, full_path string, content_hash string, error string",
    )
    found = {r.file_name: (r.content_hash, r.scan_error) for r in merge_hashes(listed, results).collect()}
    assert found["a"] == ("H", None)
    assert found["b"] == (None, "first")
    assert found["c"] == (None, None)
    assert found["d"][0] is not None


def test_coverage_of_an_empty_byte_total_is_full(spark):
    rows = files(spark, {"a": ("x", 0)}).filter("file_name = 'a'")
    assert hash_coverage(rows).first().coverage == 1.0


def test_run_ids_prune_partitions(spark, tmp_path):
    rows = files(spark, {"a": "h"}, run="r1").unionAll(files(spark, {"a": "h"}, run="r2"))
    rows.write.partitionBy("scan_run_id", "entry_type").parquet(str(tmp_path / "entries"))
    entries = spark.read.parquet(str(tmp_path / "entries"))
    runs = stage(spark.createDataFrame([("r1",)], "scan_run_id string"), "runs")
    chosen = R.current_entries(entries, runs, S.FILE)
    assert "dynamicpruning" in chosen._jdf.queryExecution().executedPlan().toString()
    found = chosen.collect()
    assert found and {r.scan_run_id for r in found} == {"r1"}
