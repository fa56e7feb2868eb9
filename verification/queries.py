"""The registered queries: each runs one operator or job over whole given tables."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold import schemas as S
from echofold.functions import paths, text
from echofold.operators import duplicates as D
from echofold.operators import folders as FO
from echofold.operators import prune as P
from echofold.operators import runs as R
from echofold.operators import summary as SU
from echofold.plans import analysis as A
from echofold.plans import cleanup as C
from echofold.plans import pipeline as CH
from echofold.plans import report as RE
from echofold.plans.inventory import InventoryOptions, inventory_of_listing, inventory_of_roots
from echofold.sources import listing as L
from echofold.sources import run_log
from echofold.sources.store import Inventory
from echofold.staging import new_path, stage
from verification import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]

GENERATED = datetime(2024, 2, 1, 12, 30, 45)
REPORT_FLOOR = 2000
REGISTRY: dict[str, Query] = {}

SET_COLUMNS = [
    "content_hash", "size_bytes", "copy_count", "wasted_bytes", "file_name", "distinct_name_count",
]


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


# Sources


@query
def listing(spark, sf_dir):
    return X.document_listing(spark, sf_dir).drop("content_hash")


@query
def hash_files(spark, sf_dir):
    return X.document_listing(spark, sf_dir).select("root", "full_path", "size_bytes", "content_hash")


@query
def hash_files_limited(spark, sf_dir):
    limited = X.document_listing(spark, sf_dir, max_hash_bytes=2000)
    return limited.select("full_path", "size_bytes", "content_hash")


@query
def file_listing(spark, sf_dir):
    """Every document as a file, listed: hidden names, names that are not UTF-8, links left out."""
    base = X.written_documents(spark, sf_dir)
    return X.beneath(L.read_listing(spark, base), base).select("full_path", "file_name", "size_bytes")


@query
def linked_file_listing(spark, sf_dir):
    """The same with links followed: they run in a circle, and some folders have no other way to them."""
    base = X.written_documents(spark, sf_dir)
    found = L.read_listings(spark, [base], follow_links=True).files
    return X.beneath(found, base).select("full_path", "file_name", "size_bytes")


def _source_roots(spark, sf_dir, base):
    """One root per source, and one that does not exist."""
    names = [row[0] for row in X.table(spark, sf_dir, "documents").select("source").distinct().collect()]
    return [f"{base}/{name}" for name in [*sorted(names), "none"]]


@query
def multi_root_listing(spark, sf_dir):
    """A root per source and one that does not exist: that one is skipped, not fatal."""
    base = X.written_documents(spark, sf_dir)
    listings = L.read_listings(spark, _source_roots(spark, sf_dir, base))
    skipped = listings.skips.select("root", "full_path", F.lit(None).cast("long").alias("size_bytes"))
    found = X.beneath(listings.files.select("root", "full_path", "size_bytes").unionByName(skipped), base)
    return found.withColumn("root", F.substr(F.col("root"), F.lit(len(base) + 2)))


@query
def file_hashes(spark, sf_dir):
    """Every document as a file, hashed block by block."""
    base = X.written_documents(spark, sf_dir)
    hashes = L.hash_results(L.read_listings(spark, [base], follow_links=True).files)
    return X.beneath(hashes, base).select("full_path", "content_hash", "error")


@query
def exclude_links(spark, sf_dir):
    return L.exclude_links(X.link_listing(spark, sf_dir)).select("full_path")


@query
def follow_links(spark, sf_dir):
    return L.exclude_links(X.link_listing(spark, sf_dir), follow_links=True).select("full_path")


@query
def skips(spark, sf_dir):
    return L.split_skips(X.failing_listing(spark, sf_dir))[1]


@query
def listed_despite_skips(spark, sf_dir):
    return L.split_skips(X.failing_listing(spark, sf_dir))[0]


@query
def write_entries(spark, sf_dir):
    """Store file and folder rows twice, emptying the tables in between, and read them back."""
    store = Inventory(spark, new_path(spark, "store"))
    rows = X.stored_entries(spark, sf_dir)
    for recreate in (False, True):
        store.create(recreate)
        store.write_entries(rows)
    return store.entries().drop("scanned_at_utc")


def _inventory(spark, sf_dir, options):
    files = X.document_listing(spark, sf_dir)
    _, denied = L.split_skips(X.failing_listing(spark, sf_dir))
    return inventory_of_listing(spark, new_path(spark, "inventory"), "batch", files, denied, options)


@query
def inventory(spark, sf_dir):
    return _inventory(spark, sf_dir, InventoryOptions()).entries().drop("scanned_at_utc")


@query
def metadata_only_inventory(spark, sf_dir):
    options = InventoryOptions(compute_hash=False)
    return _inventory(spark, sf_dir, options).entries().drop("scanned_at_utc")


@query
def inventory_without_folders(spark, sf_dir):
    options = InventoryOptions(compute_folders=False, durable_metadata=True)
    return _inventory(spark, sf_dir, options).entries().drop("scanned_at_utc")


@query
def inventory_of_files(spark, sf_dir):
    """A root per source inventoried from storage, hashed in buckets."""
    base = X.written_documents(spark, sf_dir)
    options = InventoryOptions(bucket_bytes=1 << 20)
    roots = _source_roots(spark, sf_dir, base)
    store = inventory_of_roots(spark, new_path(spark, "files"), "batch", roots, options)
    entries = store.entries().filter(F.startswith("full_path", F.lit(f"{base}/")))
    return X.beneath(entries, base).select("entry_type", "full_path", "file_name", "size_bytes", "content_hash")


@query
def root_outcomes(spark, sf_dir):
    """Roots end on their own: sources are completed, one that is missing too, one of no known store fails."""
    base = X.written_documents(spark, sf_dir)
    roots = [*_source_roots(spark, sf_dir, base), "nostore://bucket/folder"]
    store = inventory_of_roots(spark, new_path(spark, "outcomes"), "batch", roots)
    skipped = store.skips().groupBy("scan_run_id").agg(F.count(F.lit(1)).alias("folders_skipped"))
    return store.scans().join(skipped, "scan_run_id", "left").select(
        F.element_at(F.split("roots", "/"), -1).alias("root"), "status", "files_written",
        F.coalesce("folders_skipped", F.lit(0)).alias("folders_skipped"),
    )


@query
def scan_log_latest(spark, sf_dir):
    """Each run opened and closed again: the log's state is the closing event."""
    files = X.file_entries(spark, sf_dir)
    known = X.scans(spark, sf_dir).filter("drive is not null").select(F.col("drive").alias("root"))
    opening = run_log.opened(known.distinct(), "batch", datetime(2024, 1, 1), "host", True)
    of_drive = files.withColumn("root", paths.root_of("full_path"))
    of_drive = of_drive.withColumn("scan_run_id", run_log.run_id("batch"))
    closing = run_log.closed(opening, of_drive, datetime(2024, 1, 2), S.COMPLETED)
    events = opening.unionByName(closing, allowMissingColumns=True)
    return R.latest_state(events)


# Runs


@query
def latest_runs(spark, sf_dir):
    return R.latest_runs(X.scans(spark, sf_dir))


@query
def latest_runs_for_drives(spark, sf_dir):
    scans = X.scans(spark, sf_dir)
    return R.latest_runs(scans, R.canonical_drives(scans, ["s3://src1", "s3://src7/"]))


@query
def latest_runs_of_events(spark, sf_dir):
    return R.latest_runs(X.event_scans(spark, sf_dir))


@query
def incomplete_runs(spark, sf_dir):
    return R.incomplete_runs(X.event_scans(spark, sf_dir))


@query
def batch_outcome(spark, sf_dir):
    return R.batch_outcome(X.scans(spark, sf_dir))


@query
def run_durations(spark, sf_dir):
    return R.run_durations(X.scans(spark, sf_dir))


@query
def current_entries(spark, sf_dir):
    return R.current_entries(
        X.file_entries(spark, sf_dir), R.latest_runs(X.scans(spark, sf_dir)), S.FILE
    )


# Duplicate files


@query
def dup_file_sets(spark, sf_dir):
    return D.duplicate_sets(X.current_files(spark, sf_dir)).select(*SET_COLUMNS)


@query
def dup_file_sets_over_threshold(spark, sf_dir):
    return D.duplicate_sets(X.current_files(spark, sf_dir), REPORT_FLOOR).select(*SET_COLUMNS)


@query
def total_wasted(spark, sf_dir):
    return D.total_wasted(X.current_files(spark, sf_dir))


@query
def adhoc_duplicates(spark, sf_dir):
    return D.copies_by_hash(X.file_entries(spark, sf_dir))


@query
def top_dup_files(spark, sf_dir):
    files = X.current_files(spark, sf_dir)
    return D.top_sets(D.duplicate_sets(files), 10).select(*SET_COLUMNS)


@query
def dup_file_locations(spark, sf_dir):
    files = X.current_files(spark, sf_dir)
    return D.locations(files, D.duplicate_sets(files))


@query
def top_dup_file_locations(spark, sf_dir):
    """All copies of the ten most wasteful contents, read from a stored inventory by a filter on their hashes."""
    entries = R.current_entries(_stored_inventory(spark, sf_dir).entries(), R.latest_runs(X.scans(spark, sf_dir)), S.FILE)
    files = R.hashed(entries)
    top = stage(D.top_sets(D.duplicate_sets(files), 10), "top-sets")
    return D.locations(D.of_chosen(files, top), top)


@query
def dup_file_samples(spark, sf_dir):
    files = X.current_files(spark, sf_dir)
    return D.sample_locations(files, D.duplicate_sets(files), 5)


@query
def lineitem_file_sets(spark, sf_dir):
    return D.duplicate_sets(X.lineitem_files(spark, sf_dir)).select(*SET_COLUMNS)


@query
def lineitem_top_files(spark, sf_dir):
    files = X.lineitem_files(spark, sf_dir)
    return D.top_sets(D.duplicate_sets(files), 10).select(*SET_COLUMNS)


@query
def lineitem_file_samples(spark, sf_dir):
    files = X.lineitem_files(spark, sf_dir)
    return D.sample_locations(files, D.duplicate_sets(files), 2)


# Folders


@query
def folder_rollup(spark, sf_dir):
    return FO.folder_rollup(X.file_entries(spark, sf_dir))


@query
def folder_fingerprints(spark, sf_dir):
    return FO.folder_rows(X.stored_files(spark, sf_dir)).select(
        "scan_run_id", "full_path", "file_name", "size_bytes", "content_hash"
    )


@query
def folder_fingerprints_chained(spark, sf_dir):
    """The plain chain over all hashes of a folder, the value that other tools exchange."""
    return FO.chain_hashes(X.stored_files(spark, sf_dir))


@query
def lineitem_folders_chained(spark, sf_dir):
    """The same over the large inventory, whose roots hold most of the files."""
    return FO.chain_hashes(X.lineitem_files(spark, sf_dir))


@query
def folder_fingerprints_digested(spark, sf_dir):
    """The leaves that fingerprints are made of."""
    files = X.stored_files(spark, sf_dir)
    return FO.leaf_digests(files, FO.folder_rollup(files)).select("scan_run_id", "full_path", "leaf", "digest")


@query
def folder_summaries(spark, sf_dir):
    """Additive summaries of every folder's contents."""
    return FO.folder_rollup(X.file_entries(spark, sf_dir), summarize=True).select(
        "scan_run_id", "full_path", "file_count", "hashed_count", *FO.LANES
    )


@query
def lineitem_folder_fingerprints(spark, sf_dir):
    files = stage(X.lineitem_files(spark, sf_dir), "line-files")
    return FO.folder_rows(files).select("full_path", "size_bytes", "content_hash")


@query
def dup_folder_candidates(spark, sf_dir):
    return P.candidates(X.current_folders(spark, sf_dir))


def _independent(spark, sf_dir):
    return P.independent(P.candidates(X.current_folders(spark, sf_dir)))


def _members(spark, sf_dir):
    top_most = _independent(spark, sf_dir)
    sizes = P.set_sizes(top_most)
    return P.members(top_most, sizes), sizes


@query
def independent_folders(spark, sf_dir):
    return _independent(spark, sf_dir)


@query
def dup_folder_members(spark, sf_dir):
    return _members(spark, sf_dir)[0]


@query
def folder_ancestors(spark, sf_dir):
    return P.member_ancestors(_members(spark, sf_dir)[0])


@query
def folder_cover(spark, sf_dir):
    return P.cover(_members(spark, sf_dir)[0])


@query
def redundant_folder_sets(spark, sf_dir):
    return P.redundant_sets(*_members(spark, sf_dir))


@query
def dup_folder_sets(spark, sf_dir):
    return P.prune_folders(X.current_folders(spark, sf_dir)).sets().select(*SET_COLUMNS)


@query
def top_dup_folders(spark, sf_dir):
    sets = P.prune_folders(X.current_folders(spark, sf_dir)).sets()
    return D.top_sets(sets, 10).select(*SET_COLUMNS)


@query
def dup_folder_locations(spark, sf_dir):
    pruned = P.prune_folders(X.current_folders(spark, sf_dir))
    return D.locations(pruned.independent, pruned.sets())


@query
def dup_folder_samples(spark, sf_dir):
    pruned = P.prune_folders(X.current_folders(spark, sf_dir))
    return D.sample_locations(pruned.independent, pruned.sets(), 1)


@query
def lineitem_folder_sets(spark, sf_dir):
    return P.prune_folders(X.lineitem_folders(spark, sf_dir)).sets().select(*SET_COLUMNS)


# Reports


def _top(spark, sf_dir):
    return A.top_duplicates(X.stored_entries(spark, sf_dir), X.scans(spark, sf_dir), n=10, k=3)


def _full(spark, sf_dir):
    return A.duplicates_over(X.stored_entries(spark, sf_dir), X.scans(spark, sf_dir), REPORT_FLOOR)


@query
def preview_files(spark, sf_dir):
    top = _top(spark, sf_dir)
    return RE.preview(top.file_sets, top.file_locations, RE.FILES_DIFFER)


@query
def preview_folders(spark, sf_dir):
    top = _top(spark, sf_dir)
    return RE.preview(top.folder_sets, top.folder_locations, RE.FOLDERS_DIFFER)


@query
def report_sets(spark, sf_dir):
    return RE.report_sets(_full(spark, sf_dir))


@query
def report_locations(spark, sf_dir):
    return RE.report_locations(_full(spark, sf_dir))


@query
def report_yaml(spark, sf_dir):
    return RE.yaml_lines(_full(spark, sf_dir), REPORT_FLOOR, GENERATED)


# Retention and tallies


@query
def cleanup_counts(spark, sf_dir):
    return C.cleanup_plan(
        X.stored_entries(spark, sf_dir), X.skips(spark, sf_dir), X.scans(spark, sf_dir)
    ).counts


def _stored_inventory(spark, sf_dir):
    store = Inventory(spark, new_path(spark, "before"))
    store.create()
    store.write_entries(X.stored_entries(spark, sf_dir))
    store.write_skips(X.skips(spark, sf_dir))
    store.write_events(X.scans(spark, sf_dir).withColumn("event_at_utc", F.col("started_at_utc")))
    return store


@query
def cleanup_retained(spark, sf_dir):
    """A stored inventory cleaned up into a new place and read back."""
    out = new_path(spark, "after")
    C.cleanup_execute(_stored_inventory(spark, sf_dir), out)
    return Inventory(spark, out).entries().drop("scanned_at_utc")


@query
def cleanup_in_place(spark, sf_dir):
    """The same by a new version of the inventory where it lies, with the dropped runs deleted after."""
    store = _stored_inventory(spark, sf_dir)
    C.cleanup_in_place(store)
    store.vacuum()
    return store.entries().drop("scanned_at_utc")


@query
def whole_chain(spark, sf_dir):
    """Two batches of the written documents: inventory, analysis, report, cleanup of the first batch's runs."""
    base = X.written_documents(spark, sf_dir)
    roots, inventories = _source_roots(spark, sf_dir, base), new_path(spark, "chain")
    options = CH.ChainOptions(report_to=new_path(spark, "reports"), report_threshold_bytes=REPORT_FLOOR, cleanup_in_place=True)
    for batch in ("first", "second"):
        result = CH.run_chain(spark, inventories, batch, roots, options=options)
    kept = Inventory(spark, inventories).entries().filter("entry_type = 'F'").agg(F.count(F.lit(1)).alias("files_kept"))
    counted = kept.withColumn("files_deleted", F.lit(result.cleanup.files_deleted).cast("long") > 0)
    return result.analysis.file_sets.select(*SET_COLUMNS).join(F.broadcast(counted))


@query
def missing_tables(spark, sf_dir):
    """Reading an inventory that was never written: no runs, no rows. Beside it, how many a written one has."""
    written = _stored_inventory(spark, sf_dir)
    absent = Inventory(spark, new_path(spark, "absent"))
    tables = {"entries": Inventory.entries, "skips": Inventory.skips, "scans": Inventory.scans}
    counted = [
        read(written).agg(F.count(F.lit(1)).alias("written")).select(F.lit(name).alias("name"), "written").join(
            read(absent).agg(F.count(F.lit(1)).alias("absent"))
        )
        for name, read in tables.items()
    ]
    return counted[0].unionAll(counted[1]).unionAll(counted[2])


@query
def merge_hashes(spark, sf_dir):
    """Hash results of the newest run merged into rows listed without hashes."""
    files = X.file_entries(spark, sf_dir)
    listed = files.withColumn("content_hash", F.lit(None).cast("string"))
    results = files.select(
        "scan_run_id", "full_path", "content_hash",
        F.when(F.col("content_hash").isNull(), F.lit("IOException: second try")).alias("error"),
    )
    return SU.merge_hashes(listed, results).select(
        "scan_run_id", "full_path", "content_hash", "scan_error"
    )


@query
def scan_totals(spark, sf_dir):
    return SU.scan_totals(X.stored_entries(spark, sf_dir), X.skips(spark, sf_dir))


@query
def scan_totals_by_run(spark, sf_dir):
    return SU.scan_totals_by_run(X.stored_entries(spark, sf_dir), X.skips(spark, sf_dir))


@query
def hash_coverage(spark, sf_dir):
    return SU.hash_coverage(X.file_entries(spark, sf_dir))


# Scalar functions


@query
def path_functions(spark, sf_dir):
    return X.sized_paths(spark, sf_dir).select(
        "path",
        paths.parent_path("path").alias("parent"),
        F.array_join(paths.ancestors("path"), "|").alias("ancestors"),
        paths.leaf_name("path").alias("leaf"),
    )


@query
def parent_path_sql(spark, sf_dir):
    """The same function called from SQL text."""
    paths.register_sql_functions(spark)
    return X.sized_paths(spark, sf_dir).selectExpr("path", "parent_path(path) as parent")


@query
def normalize_drive(spark, sf_dir):
    raw = X.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "explode(array(lower(left(c_name, 1)), left(c_name, 1) || ':', "
        "c_name, '/' || c_name, 's3://' || c_name || '/')) as raw"
    )
    return raw.select("c_custkey", "raw", paths.normalize_drive("raw").alias("drive"))


@query
def format_bytes(spark, sf_dir):
    """Sizes from bytes to petabytes made from every line item."""
    sized = X.table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey * cast(l_quantity as bigint) as small",
        "explode(array(1L, 37L, 4099L, 262144L, 41943040L, 9663676416L)) as factor",
    ).selectExpr("small * factor as size_bytes").distinct()
    return sized.select("size_bytes", text.format_bytes(F.col("size_bytes")).alias("label"))


@query
def display_stamps(spark, sf_dir):
    events = X.table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        text.iso_utc(F.col("ts")).alias("iso"),
        text.file_stamp(F.col("ts")).alias("file_stamp"),
        text.display_stamp(F.col("ts")).alias("display_stamp"),
    )


@query
def yaml_quoted(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.yaml_quote(F.col("html")).alias("quoted"))
