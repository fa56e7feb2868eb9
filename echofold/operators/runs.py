"""Selecting and describing scan runs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold import schemas as S
from echofold.functions import paths, text


def eligible_runs(scans: DataFrame, drives: list[str] | None = None) -> DataFrame:
    """Completed runs with a known drive, optionally only those of the given canonical drives."""
    runs = scans.filter((F.col("status") == S.COMPLETED) & F.col("drive").isNotNull())
    return runs.filter(F.col("drive").isin(drives)) if drives else runs


def latest_runs(
    scans: DataFrame, drives: list[str] | None = None, require_hash: bool = False
) -> DataFrame:
    """The newest completed run of each drive; equal completion times fall to the lower id.

    The rank filter is applied before the shuffle as well, so a drive owning a large share of all
    runs sends one row per task. ``require_hash`` skips runs made without hashing.
    """
    runs = eligible_runs(scans, drives)
    if require_hash:
        runs = runs.filter("compute_hash")
    newest = Window.partitionBy("drive").orderBy(
        F.col("completed_at_utc").desc_nulls_last(), F.col("scan_run_id")
    )
    return (
        runs.select("drive", F.rtrim("scan_run_id").alias("scan_run_id"), "completed_at_utc")
        .withColumn("recency", F.row_number().over(newest))
        .filter("recency = 1")
        .drop("recency")
    )


def canonical_drives(scans: DataFrame, raw: list[str]) -> list[str]:
    """The caller's drive names in canonical form."""
    spark = scans.sparkSession
    names = spark.createDataFrame([(name,) for name in raw], "raw string")
    return [row[0] for row in names.select(paths.normalize_drive("raw")).collect()]


def incomplete_runs(scans: DataFrame) -> DataFrame:
    """Runs that never finished: still marked running, or without a completion time."""
    return scans.filter((F.col("status") == S.RUNNING) | F.col("completed_at_utc").isNull())


def of_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the given runs only.

    ``scan_run_id`` is a partition column of a stored inventory, so the join prunes partitions at run
    time: files of other runs are not read. Spark prunes by a side that has a filter; the comparison,
    which every id passes, is one for lists that were staged.
    """
    wanted = runs.select("scan_run_id").filter(F.col("scan_run_id") >= "")
    return rows.join(wanted, "scan_run_id", "left_semi").select(*rows.columns)


def current_entries(entries: DataFrame, runs: DataFrame, entry_type: str | None = None) -> DataFrame:
    """Rows of the selected runs, of one type if given."""
    if entry_type is not None:
        entries = entries.filter(F.col("entry_type") == entry_type)
    return of_runs(entries, runs)


def hashed(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("content_hash").isNotNull())


def latest_state(scan_events: DataFrame) -> DataFrame:
    """The run log as one row per run: its most recent event."""
    newest = Window.partitionBy("scan_run_id").orderBy(
        F.col("event_at_utc").desc(), F.col("completed_at_utc").desc_nulls_last()
    )
    return (
        scan_events.withColumn("recency", F.row_number().over(newest))
        .filter("recency = 1")
        .select(*S.SCANS.names)
    )


def _severity(status: Column) -> Column:
    return F.when(status == S.FAILED, 2).when(status == S.CANCELED, 1).when(status == S.COMPLETED, 0)


def batch_outcome(scans: DataFrame) -> DataFrame:
    """The worst outcome over all finished runs, with its process exit code."""
    worst = scans.agg(F.max(_severity(F.col("status"))).alias("worst"))
    return worst.select(
        F.when(F.col("worst") == 2, S.FAILED)
        .when(F.col("worst") == 1, S.CANCELED)
        .when(F.col("worst") == 0, S.COMPLETED)
        .alias("status"),
        F.when(F.col("worst") == 2, 1)
        .when(F.col("worst") == 1, 130)
        .when(F.col("worst") == 0, 0)
        .cast("long")
        .alias("exit_code"),
    )


def run_durations(scans: DataFrame) -> DataFrame:
    """How long each finished run took."""
    seconds = text.seconds_between(F.col("started_at_utc"), F.col("completed_at_utc"))
    return (
        scans.filter("completed_at_utc is not null")
        .select("scan_run_id", "drive", seconds.alias("duration_seconds"))
        .withColumn("elapsed", text.clock(F.col("duration_seconds")))
    )
