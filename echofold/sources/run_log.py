"""Opening and closing scan runs as events of the run log."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold import schemas as S
from echofold.functions import paths
from echofold.sources.store import ntz


def run_id(batch: str, root: str = "root") -> Column:
    """One run per root of a batch; the id follows from both, so retried jobs agree on it."""
    return F.concat(F.lit(f"{batch}-"), F.sha2(F.col(root), 256))


def opened(roots: DataFrame, batch: str, at: datetime, machine: str, compute_hash: bool) -> DataFrame:
    """The opening event of each root's run."""
    return roots.select(
        ntz(at).alias("event_at_utc"),
        run_id(batch).alias("scan_run_id"),
        ntz(at).alias("started_at_utc"),
        F.lit(S.RUNNING).alias("status"),
        F.lit(machine).alias("machine_name"),
        paths.normalize_drive("root").alias("drive"),
        F.col("root").alias("roots"),
        F.lit(compute_hash).alias("compute_hash"),
    )


def files_written(entries: DataFrame) -> DataFrame:
    """File rows per run; folder rows are not counted."""
    is_file = F.col("entry_type") == S.FILE
    return entries.groupBy("scan_run_id").agg(F.count_if(is_file).alias("files_written"))


def closed(
    open_events: DataFrame, entries: DataFrame, at: datetime, status: str, error: str | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """The closing event of each run: completion time, outcome, rows written, error.

    ``failures`` (scan_run_id, error) names runs that failed on their own, whatever the others did.
    """
    written = files_written(entries)
    closing = open_events.drop("event_at_utc", "completed_at_utc", "status", "files_written", "scan_error")
    closing = closing.join(written, "scan_run_id", "left")
    own = F.lit(None).cast("string")
    if failures is not None:
        failed = failures.select("scan_run_id", F.col("error").alias("own_error"))
        closing, own = closing.join(failed, "scan_run_id", "left"), F.col("own_error")
    return closing.select(
        *[c for c in closing.columns if c not in ("own_error", "files_written")],
        F.coalesce("files_written", F.lit(0)).alias("files_written"),
        ntz(at).alias("event_at_utc"),
        ntz(at).alias("completed_at_utc"),
        F.when(own.isNotNull(), S.FAILED).otherwise(status).alias("status"),
        F.coalesce(own, F.lit(error).cast("string")).alias("scan_error"),
    )
