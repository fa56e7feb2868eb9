"""File listings and content hashes, from storage roots or from tables that already hold contents.

A listing has the columns ``root, full_path, file_name, size_bytes, date_modified_utc,
date_created_utc``; a listing made from a table also has ``content_hash``.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions import paths, text
from echofold.sources import storage
from echofold.staging import stage

_TASKS_PER_CORE = 2
# Bytes that one task hashes, about.
_TASK_BYTES = 1 << 30

SKIPPED = "root string, full_path string, reason string"


def _tasks(spark: SparkSession) -> int:
    return _TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def _not_entered(folders: DataFrame, entered: list[DataFrame]) -> DataFrame:
    """Each folder of a frontier once, by its first path, unless it was entered before.

    Folders are told by their identity in the store, where it has one, so a folder that many links
    lead to is one folder.
    """
    place = F.coalesce("identity", "full_path").alias("place")
    frontier = folders.select("root", place, "full_path").groupBy("root", "place")
    frontier = frontier.agg(F.min("full_path").alias("full_path"))
    if not entered:
        return frontier
    known = reduce(DataFrame.unionAll, entered).select("root", "place")
    return frontier.join(known, ["root", "place"], "left_anti")


def walk(spark: SparkSession, roots: list[str], follow_links: bool = False) -> DataFrame:
    """Everything beneath the roots: files, folders, links, and folders that could not be listed.

    One pass per depth: the folders of a level are dealt over the tasks, and what each task finds is
    stored, so no listing passes through the driver. A task goes through a local folder entry by entry;
    stores that hand out a folder in one piece need memory for their largest one. Roots are kept apart:
    overlapping ones list a shared file once each.

    When links are followed, the folders that lie beneath the roots come first, then level by level those
    that only links lead to. A folder is entered once, so links in a circle end.
    """
    level = spark.createDataFrame([(root, storage.full_form(root)) for root in roots], "root string, full_path string")
    if follow_links:
        level = level.mapInPandas(storage.identify, "root string, full_path string, identity string")
    found: list[DataFrame] = []
    entered: list[DataFrame] = []
    while True:
        if follow_links:
            entered.append(stage(_not_entered(level, entered), "entered-level"))
            level = entered[-1]
        # A fixed number of tasks keeps adaptive execution from packing slow, tiny rows into one.
        dealt = level.select("root", "full_path").repartition(_tasks(spark), "root", "full_path")
        found.append(stage(dealt.mapInPandas(storage.list_folders, storage.LISTED), "listed-level"))
        level = found[-1].filter("is_dir and not is_link and list_error is null")
        if level.isEmpty():
            if not follow_links:
                return reduce(DataFrame.unionAll, found)
            links = reduce(DataFrame.unionAll, found).filter("is_dir and is_link")
            level = stage(_not_entered(links, entered), "linked-folders").withColumnRenamed("place", "identity")
            if level.isEmpty():
                return reduce(DataFrame.unionAll, found)


@dataclass(frozen=True)
class RootListings:
    """The files of several roots, the folders that could not be listed, and roots whose listing failed.

    ``skips`` has (root, full_path, reason), ``failures`` (root, error).
    """

    files: DataFrame
    skips: DataFrame
    failures: DataFrame


def read_listings(spark: SparkSession, roots: list[str], follow_links: bool = False) -> RootListings:
    """Files beneath the roots, whatever their names.

    Links to files are left out: the file is listed where it lies. Folders behind links are entered
    only if links are followed.
    """
    listed = walk(spark, roots, follow_links)
    found, skips = split_skips(listed)
    files = found.filter("not is_dir and not is_link").select(
        "root", "full_path", paths.leaf_name("full_path").alias("file_name"), "size_bytes", "date_modified_utc",
        F.lit(None).cast("timestamp_ntz").alias("date_created_utc"),
    )
    broken = split_skips(listed.filter("is_fatal"))[1]
    return RootListings(files, skips, broken.groupBy("root").agg(F.min("reason").alias("error")))


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """Every file beneath a root."""
    return read_listings(spark, [root]).files


def within_limit(size: Column, max_hash_bytes: int) -> Column:
    """Whether a file is small enough to hash; a non-positive limit means none."""
    return size <= max_hash_bytes if max_hash_bytes > 0 else F.lit(True)


def content_hash(content: Column, size: Column, max_hash_bytes: int = 0) -> Column:
    """SHA-256 of the whole content; null beyond the size limit."""
    digest = F.sha2(content, 256)
    return F.when(within_limit(size, max_hash_bytes), digest) if max_hash_bytes > 0 else digest


def hash_results(files: DataFrame, max_hash_bytes: int = 0) -> DataFrame:
    """A hash or an error for every listed file within the size limit, block by block at any size."""
    wanted = files.filter(within_limit(F.col("size_bytes"), max_hash_bytes))
    total = wanted.agg(F.sum("size_bytes")).first()[0] or 0
    tasks = max(_tasks(files.sparkSession), total // _TASK_BYTES)
    dealt = wanted.select("root", "full_path").repartition(tasks, "root", "full_path")
    return dealt.mapInPandas(storage.hash_files, storage.HASH_RESULTS)


def listing_from_table(
    table: DataFrame,
    path: str,
    root: str | None = None,
    content: str | None = None,
    size: str | None = None,
    modified: str | None = None,
    created: str | None = None,
    max_hash_bytes: int = 0,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """A listing, with hashes, of a table that holds paths and contents. Arguments name columns.

    Without ``root`` each path's own root is taken; without ``size`` the content is measured. The
    columns named in ``keep`` are carried along.
    """
    def timestamp(column: str | None) -> Column:
        return (F.col(column) if column else F.lit(None)).cast("timestamp_ntz")

    body = F.col(content).cast("binary") if content else None
    length = (F.col(size) if size else F.octet_length(body)).cast("long")
    digest = content_hash(body, length, max_hash_bytes) if content else F.lit(None).cast("string")
    return table.select(
        (F.col(root) if root else paths.root_of(path)).alias("root"),
        F.col(path).alias("full_path"),
        paths.leaf_name(path).alias("file_name"),
        length.alias("size_bytes"),
        timestamp(modified).alias("date_modified_utc"),
        timestamp(created).alias("date_created_utc"),
        digest.alias("content_hash"),
        *keep,
    )


def exclude_links(listing: DataFrame, follow_links: bool = False) -> DataFrame:
    """Drop link files, and everything beneath link directories unless those are followed.

    Needs the columns ``is_dir`` and ``is_link``. The test runs once per folder, not per file.
    """
    files = listing.filter("not is_dir and not is_link")
    if follow_links:
        return files
    linked = listing.filter("is_dir and is_link").select(F.col("full_path").alias("ancestor")).distinct()
    in_folder = files.withColumn("folder", paths.parent_path("full_path"))
    hidden = (
        paths.with_ancestors(in_folder.select("folder").distinct(), "folder", "ancestor")
        .join(linked, "ancestor", "left_semi")
        .select("folder")
        .distinct()
    )
    return in_folder.join(hidden, "folder", "left_anti").drop("folder")


def split_skips(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that were listed, and directories that were not with the reason.

    Needs the columns ``list_error_type`` and ``list_error``.
    """
    failed = F.col("list_error").isNotNull()
    files = listing.filter(~failed).drop("list_error_type", "list_error")
    reason = text.error_text(F.col("list_error_type"), F.col("list_error"))
    return files, listing.filter(failed).select("root", "full_path", reason.alias("reason"))
