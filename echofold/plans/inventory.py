"""Building an inventory: list, hash, roll up folders, and log each root's run.

An inventory of storage roots can stop at any point and go on later. Its listing is stored before any
file is read. Files are then hashed bucket by bucket, many small ones at a time; a bucket's results are stored, and only then marked
as finished, so an interrupted bucket is done again and a finished one never. ``resume_inventory`` does
what is left.
"""

import socket
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold import schemas as S
from echofold.operators.folders import folder_rows
from echofold.operators.runs import of_runs
from echofold.operators.summary import merge_hashes
from echofold.sources import listing as L
from echofold.sources import run_log
from echofold.sources.store import Inventory, ntz, utc_now
from echofold.staging import stage

# Bytes that one task hashes in a bucket, about.
_TASK_BYTES = 1 << 30
# Jobs in which the buckets of an inventory are hashed, at most.
_MOST_ROUNDS = 32


@dataclass(frozen=True)
class InventoryOptions:
    compute_hash: bool = True
    compute_folders: bool = True
    max_hash_bytes: int = 0
    # For listings that carry their hashes: store them without hashes first.
    durable_metadata: bool = False
    recreate: bool = False
    follow_links: bool = False
    # Bytes hashed between two marks of progress, or a 32nd of all if that is more; by default what keeps the
    # cluster busy for a while.
    bucket_bytes: int | None = None


def file_entries(files: DataFrame, batch: str, compute_hash: bool = True) -> DataFrame:
    """Listed files as entry rows of their root's run."""
    has_hash = compute_hash and "content_hash" in files.columns
    return files.select(
        run_log.run_id(batch).alias("scan_run_id"),
        F.lit(S.FILE).alias("entry_type"),
        "file_name",
        "full_path",
        "size_bytes",
        "date_modified_utc",
        "date_created_utc",
        (F.col("content_hash") if has_hash else F.lit(None)).cast("string").alias("content_hash"),
        (F.col("scan_error") if "scan_error" in files.columns else F.lit(None)).cast("string").alias("scan_error"),
    )


def _stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("scanned_at_utc", ntz(utc_now()))


def _message(error: Exception) -> str:
    return str(error).splitlines()[0] if str(error) else type(error).__name__


def _open_runs(store: Inventory, batch: str, roots: DataFrame, options: InventoryOptions) -> DataFrame:
    """Log the start of each root's run; a batch name is used once."""
    store.create(options.recreate)
    opening = run_log.opened(roots, batch, utc_now(), socket.gethostname(), options.compute_hash)
    opening = stage(opening, "opened-runs")
    # A name used again would add the same files to the same run once more.
    if not store.scan_events().join(opening.select("scan_run_id"), "scan_run_id", "left_semi").isEmpty():
        raise ValueError(f"the run log already holds runs of batch {batch!r}; choose another name")
    store.write_events(opening)
    return opening


def _close_runs(
    store: Inventory, opening: DataFrame, status: str, error: str | None = None, failures: DataFrame | None = None,
) -> None:
    mine = of_runs(store.entries(), opening)
    store.write_events(run_log.closed(opening, mine, utc_now(), status, error, failures))


def _logged(store: Inventory, opening: DataFrame, work: Callable[[], DataFrame | None]) -> None:
    """Do the work and close the runs with its outcome; roots that it names as failed get their own."""
    try:
        failures = work()
    except KeyboardInterrupt:
        _close_runs(store, opening, S.CANCELED)
        raise
    except Exception as error:
        _close_runs(store, opening, S.FAILED, _message(error))
        raise
    _close_runs(store, opening, S.COMPLETED, failures=failures)


def _write_folders(store: Inventory, runs: DataFrame) -> None:
    stored = of_runs(store.entries().filter(F.col("entry_type") == S.FILE), runs)
    store.write_entries(_stamped(folder_rows(stored)), replace=True)


def _write_listing(store: Inventory, batch: str, roots: list[str], options: InventoryOptions) -> None:
    """List the roots and store what was found, in place of what an interrupted attempt may have left."""
    found = L.read_listings(store.spark, roots, options.follow_links)
    store.write_skips(_stamped(found.skips.withColumn("scan_run_id", run_log.run_id(batch))), replace=True)
    store.write_entries(_stamped(file_entries(found.files, batch)), replace=True)
    store.write_failures(found.failures.select(run_log.run_id(batch).alias("scan_run_id"), "error"), batch)
    wanted = found.files.filter(L.within_limit(F.col("size_bytes"), options.max_hash_bytes))
    total = wanted.agg(F.sum("size_bytes")).first()[0] or 0
    each = options.bucket_bytes or _TASK_BYTES * store.spark.sparkContext.defaultParallelism
    store.write_progress(batch, S.LISTED, max(1, -(-total // each)))


def _write_hashes(store: Inventory, batch: str, files: DataFrame, options: InventoryOptions) -> None:
    """Hash the files bucket by bucket, but for those finished, and merge all results into the entries.

    Of more than ``_MOST_ROUNDS`` buckets several are done and marked together, so the number of jobs does
    not grow with the bytes.

    A file's bucket follows from its run and path and from the number of buckets that was stored with
    the listing, so it is the same after a restart on another cluster.
    """
    done = store.progress(batch).select("step", "number").collect()
    (n_buckets,) = [r["number"] for r in done if r["step"] == S.LISTED][:1]
    finished = {r["number"] for r in done if r["step"] == S.HASHED}
    bucket = F.pmod(F.xxhash64("scan_run_id", "full_path"), F.lit(n_buckets))
    n_rounds = min(n_buckets, _MOST_ROUNDS)
    pending = files.select(
        F.col("scan_run_id").alias("root"), "full_path", "size_bytes", bucket.alias("bucket"),
        F.pmod(bucket, F.lit(n_rounds)).alias("round"),
    )
    pending = pending.join(F.broadcast(store.finished(batch)), "bucket", "left_anti").hint("rebalance", "round")
    # A folder per round, so that each round's job reads its own rows only.
    pending = stage(pending, "pending-files", partition_by=("round",))
    of_result = F.pmod(F.xxhash64("root", "full_path"), F.lit(n_buckets))
    for number in range(n_rounds):
        buckets = [b for b in range(number, n_buckets, n_rounds) if b not in finished]
        if buckets:
            results = L.hash_results(pending.filter(F.col("round") == number), options.max_hash_bytes)
            results = results.withColumn("bucket", of_result).withColumnRenamed("root", "scan_run_id")
            store.write_hashes(results, batch)
            store.write_progress(batch, S.HASHED, *buckets)
    # A copy, as the entries that it is read from are replaced by it.
    merged = stage(merge_hashes(files, store.hashes(batch)), "merged-entries")
    store.write_entries(_stamped(merged.drop("scanned_at_utc")), replace=True)


def _fill_in(store: Inventory, batch: str, opening: DataFrame, roots: list[str], options: InventoryOptions) -> DataFrame:
    """All steps of an inventory of roots that are not finished yet; returns the runs that failed."""
    if store.progress(batch).filter(F.col("step") == S.LISTED).isEmpty():
        _write_listing(store, batch, roots, options)
    failures = store.failures(batch)
    sound = opening.join(failures, "scan_run_id", "left_anti")
    if options.compute_hash and not sound.isEmpty():
        sound = stage(sound.select("scan_run_id"), "sound-runs")
        _write_hashes(store, batch, of_runs(store.entries().filter(F.col("entry_type") == S.FILE), sound), options)
        if options.compute_folders:
            _write_folders(store, sound)
    return failures


def inventory_of_roots(
    spark: SparkSession, base: str, batch: str, roots: list[str],
    options: InventoryOptions = InventoryOptions(),
) -> Inventory:
    """Inventory every file beneath the given storage roots, one run per root.

    Roots have outcomes of their own: one whose listing fails keeps what was found and is closed as
    failed, while the others are completed.
    """
    store = Inventory(spark, base)
    opening = _open_runs(store, batch, spark.createDataFrame([(root,) for root in roots], "root string"), options)
    _logged(store, opening, lambda: _fill_in(store, batch, opening, roots, options))
    return store


def resume_inventory(
    spark: SparkSession, base: str, batch: str, options: InventoryOptions = InventoryOptions()
) -> Inventory:
    """Go on with a batch of roots that was interrupted, wherever it stopped.

    Takes the options that it was started with. Runs that are completed stay as they are; a batch with
    nothing left to do is refused.
    """
    store = Inventory(spark, base)
    log = store.scan_events().filter(F.startswith("scan_run_id", F.lit(f"{batch}-")))
    ended = log.filter(F.col("status") == S.COMPLETED).select("scan_run_id")
    opening = log.filter(F.col("status") == S.RUNNING).join(ended, "scan_run_id", "left_anti")
    opening = stage(opening.dropDuplicates(["scan_run_id"]), "reopened-runs")
    # One name per root of the batch, as they were given.
    roots = sorted(row["roots"] for row in opening.select("roots").collect())
    if not roots:
        raise ValueError(f"no run of batch {batch!r} is left to finish")
    _logged(store, opening, lambda: _fill_in(store, batch, opening, roots, options))
    return store


def inventory_of_listing(
    spark: SparkSession, base: str, batch: str, files: DataFrame, skips: DataFrame | None = None,
    options: InventoryOptions = InventoryOptions(),
) -> Inventory:
    """Inventory a listing that already carries its hashes, one run per root found in it."""
    store = Inventory(spark, base)
    if skips is None:
        skips = spark.createDataFrame([], L.SKIPPED)
    roots = files.select("root").unionByName(skips.select("root")).distinct()
    opening = _open_runs(store, batch, roots, options)

    def write() -> None:
        # First, so that even a run that fails later leaves them behind.
        store.write_skips(_stamped(skips.withColumn("scan_run_id", run_log.run_id(batch))))
        listed = file_entries(files, batch, options.compute_hash)
        if options.durable_metadata:
            store.write_entries(_stamped(listed.withColumn("content_hash", F.lit(None).cast("string"))))
        if not options.durable_metadata or options.compute_hash:
            store.write_entries(_stamped(listed), replace=options.durable_metadata)
        if options.compute_hash and options.compute_folders:
            _write_folders(store, opening)

    _logged(store, opening, write)
    return store
