"""Dropping the rows of superseded, unfinished and unknown runs; the run log always stays."""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold import schemas as S
from echofold.operators import retention
from echofold.operators.runs import latest_runs
from echofold.plans.analysis import NoCompletedRun
from echofold.sources.store import Inventory
from echofold.staging import stage


@dataclass(frozen=True)
class CleanupPlan:
    """The runs to keep (of every drive) and one row of counts to delete."""

    kept_runs: DataFrame
    counts: DataFrame


def cleanup_plan(entries: DataFrame, skips: DataFrame, scans: DataFrame) -> CleanupPlan:
    kept = stage(latest_runs(scans), "kept-runs")
    if kept.isEmpty():
        raise NoCompletedRun("no completed run found; refusing to delete every row")
    return CleanupPlan(kept.orderBy("drive"), retention.delete_counts(entries, skips, kept))


@dataclass(frozen=True)
class CleanupResult:
    files_deleted: int
    skips_deleted: int
    written: bool


def cleanup_execute(store: Inventory, out: str, dry_run: bool = False) -> CleanupResult:
    """Write the retained inventory to ``out``; nothing is written when there is nothing to drop.

    Only retained partitions are read. The source stays as it is: switch readers over, then delete it.
    """
    if not store.has_log():
        raise NoCompletedRun("there is no run log to tell which runs to keep")
    plan = cleanup_plan(store.entries(), store.skips(), store.scans())
    files, skips = plan.counts.first()
    if dry_run or (files == 0 and skips == 0):
        return CleanupResult(files, skips, written=False)
    target = Inventory(store.spark, out)
    target.create()
    for entry_type in (S.FILE, S.FOLDER):
        rows = store.entries().filter(f"entry_type = '{entry_type}'")
        target.write_entries(retention.retained(rows, plan.kept_runs))
    target.write_skips(retention.retained(store.skips(), plan.kept_runs))
    target.write_events(store.scan_events())
    return CleanupResult(files, skips, written=True)


def cleanup_in_place(store: Inventory, dry_run: bool = False) -> CleanupResult:
    """Drop superseded runs from a path-based inventory by committing a new version of it.

    No row is rewritten, and readers see either version whole. ``store.vacuum()`` frees the space later.
    """
    if not store.has_log():
        raise NoCompletedRun("there is no run log to tell which runs to keep")
    entries, skips = store.entries(), store.skips()
    plan = cleanup_plan(entries, skips, store.scans())
    files, skipped = plan.counts.first()
    if dry_run or (files == 0 and skipped == 0):
        return CleanupResult(files, skipped, written=False)
    known = entries.select("scan_run_id").union(skips.select("scan_run_id")).distinct()
    store.commit_dropped(retention.not_retained(known, plan.kept_runs))
    return CleanupResult(files, skipped, written=True)


# Partitions named in one statement.
_DROP_BATCH = 100


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _dropped(rows: DataFrame, keys: list[str], kept_runs: DataFrame) -> Iterator[tuple[str, int]]:
    """The partitions to drop, as specifications with their row counts; one row per partition."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # Written first: the table that it is counted from is about to change.
    for row in stage(retention.not_retained(counted, kept_runs), "dropped-partitions").toLocalIterator():
        yield ", ".join(f"{key} = {_literal(row[key])}" for key in keys), row["n"]


def cleanup_tables(
    spark: SparkSession, entries: str, skips: str, scans: DataFrame, dry_run: bool = False
) -> CleanupResult:
    """Clean up managed catalog tables in place, partitioned as the stored inventory is.

    Every row of a run lies in partitions of its own, so dropping those rewrites no data.
    """
    kept = stage(latest_runs(scans), "kept-runs")
    if kept.isEmpty():
        raise NoCompletedRun("no completed run found; refusing to delete every row")
    deleted = []
    for table, keys in [(entries, ["scan_run_id", "entry_type"]), (skips, ["scan_run_id"])]:
        total = 0
        for batch in batched(_dropped(spark.table(table), keys, kept), _DROP_BATCH):
            if not dry_run:
                specs = ", ".join(f"partition ({spec})" for spec, _ in batch)
                spark.sql(f"alter table {table} drop if exists {specs}")
            total += sum(n for _, n in batch)
        deleted.append(total)
    return CleanupResult(*deleted, written=not dry_run and any(deleted))
