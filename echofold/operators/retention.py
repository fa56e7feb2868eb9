"""Which rows outlive a cleanup: those of the newest completed run of each drive."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.operators.runs import of_runs


def retained(rows: DataFrame, kept_runs: DataFrame) -> DataFrame:
    return of_runs(rows, kept_runs)


def not_retained(rows: DataFrame, kept_runs: DataFrame) -> DataFrame:
    """Rows of superseded, unfinished or unknown runs."""
    return rows.join(kept_runs.select("scan_run_id"), "scan_run_id", "left_anti")


def delete_counts(entries: DataFrame, skips: DataFrame, kept_runs: DataFrame) -> DataFrame:
    """One row: how many entry and skip rows a cleanup removes.

    Rows are counted per run before the join with the kept runs, so no data row is shuffled.
    """
    def per_run(rows: DataFrame, is_entry: int) -> DataFrame:
        counted = rows.groupBy("scan_run_id").agg(F.count(F.lit(1)).alias("n"))
        return counted.withColumn("is_entry", F.lit(is_entry))

    gone = not_retained(per_run(entries, 1).unionByName(per_run(skips, 0)), kept_runs)
    return gone.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("is_entry") == flag, F.col("n"))), F.lit(0))
            .cast("long")
            .alias(name)
            for flag, name in [(1, "files_to_delete"), (0, "skips_to_delete")]
        ]
    )
