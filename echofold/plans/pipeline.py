"""Inventory, analysis, report and cleanup as one chain."""

import logging
from dataclasses import dataclass

from pyspark.sql import SparkSession

from echofold.plans.analysis import DuplicateAnalysis, duplicates_over, top_duplicates
from echofold.plans.cleanup import CleanupResult, cleanup_execute, cleanup_in_place
from echofold.plans.inventory import InventoryOptions, inventory_of_roots
from echofold.plans.report import report_name, write_report
from echofold.sources.store import Inventory, utc_now

log = logging.getLogger(__name__)

REPORT_THRESHOLD_BYTES = 100 << 20


@dataclass(frozen=True)
class ChainOptions:
    top: int = 10
    samples: int = 5
    drives: list[str] | None = None
    report_to: str | None = None
    report_threshold_bytes: int = REPORT_THRESHOLD_BYTES
    cleanup_to: str | None = None
    cleanup_in_place: bool = False
    dry_run: bool = False
    analyze: bool = True


@dataclass(frozen=True)
class ChainResult:
    analysis: DuplicateAnalysis | None = None
    report_path: str | None = None
    cleanup: CleanupResult | None = None


def run_chain(
    spark: SparkSession, base: str, batch: str, roots: list[str],
    inventory: InventoryOptions = InventoryOptions(), options: ChainOptions = ChainOptions(),
) -> ChainResult:
    """Inventory the roots, then analyze, report and clean up. Only the inventory's own failure is raised."""
    store = inventory_of_roots(spark, base, batch, roots, inventory)
    return after_inventory(store, inventory.compute_hash, options)


def after_inventory(store: Inventory, compute_hash: bool, options: ChainOptions) -> ChainResult:
    """Analyze, report and clean up. The inventory is done: failures here are logged, not raised.

    Skipped without hashes. The report runs only when a destination is given, the cleanup when it has one or
    is to happen in place.
    """
    if not (compute_hash and options.analyze):
        return ChainResult()
    try:
        analysis = top_duplicates(
            store.entries(), store.scans(), options.top, options.samples, options.drives
        )
    except Exception:
        log.exception("inventory succeeded, but the analysis failed")
        return ChainResult()
    return ChainResult(analysis, _report(store, options), _clean(store, options))


def _report(store: Inventory, options: ChainOptions) -> str | None:
    if options.report_to is None:
        return None
    generated = utc_now()
    path = f"{options.report_to.rstrip('/')}/{report_name(generated)}"
    try:
        full = duplicates_over(
            store.entries(), store.scans(), options.report_threshold_bytes, options.drives
        )
        write_report(full, path, options.report_threshold_bytes, generated)
    except Exception:
        log.exception("analysis succeeded, but the report failed")
        return None
    return path


def _clean(store: Inventory, options: ChainOptions) -> CleanupResult | None:
    if options.cleanup_to is None and not options.cleanup_in_place:
        return None
    try:
        if options.cleanup_in_place:
            return cleanup_in_place(store, options.dry_run)
        return cleanup_execute(store, options.cleanup_to, options.dry_run)
    except Exception:
        log.exception("analysis succeeded, but the cleanup failed")
        return None
