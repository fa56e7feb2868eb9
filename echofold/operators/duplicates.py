"""Duplicate sets: rows that share a content hash and a size, files and folders alike."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions import text
from echofold.schemas import CONTENT_KEY

# Parts in which the copies of one content are ranked on their own first.
PATH_BUCKETS = 64
# Contents named in a filter.
MOST_LITERALS = 200


def duplicate_sets(rows: DataFrame, min_wasted: int = 0) -> DataFrame:
    """Sets of two or more copies that waste at least ``min_wasted`` bytes.

    Copies are first counted per name, which spreads one very common content over many tasks and
    keeps that step a hash aggregate; the second step then sees one row per name.
    """
    key = ["packed", "size_bytes"]
    packed = rows.withColumn("packed", text.packed_hash(F.col("content_hash")))
    per_name = packed.groupBy(*key, "file_name").agg(F.count(F.lit(1)).alias("copies"))
    return (
        per_name.groupBy(*key)
        .agg(
            F.sum("copies").alias("copy_count"),
            F.min("file_name").alias("file_name"),
            F.count("file_name").alias("distinct_name_count"),
        )
        .withColumn("wasted_bytes", (F.col("copy_count") - 1) * F.col("size_bytes"))
        .filter((F.col("copy_count") > 1) & (F.col("wasted_bytes") >= min_wasted))
        .select(
            text.unpacked_hash(F.col("packed")).alias("content_hash"), "size_bytes",
            "copy_count", "file_name", "distinct_name_count", "wasted_bytes",
        )
    )


def total_of_sets(sets: DataFrame) -> DataFrame:
    """Reclaimable bytes over the given sets; 0 when there are none."""
    total = F.coalesce(F.sum("wasted_bytes"), F.lit(0)).cast("long")
    return sets.agg(total.alias("total_wasted_bytes"))


def total_wasted(rows: DataFrame) -> DataFrame:
    """Reclaimable bytes over all sets of the rows, without working out their names."""
    sets = (
        rows.groupBy(*CONTENT_KEY)
        .agg(F.count(F.lit(1)).alias("copy_count"))
        .filter("copy_count > 1")
    )
    return total_of_sets(sets.selectExpr("(copy_count - 1) * size_bytes as wasted_bytes"))


def top_sets(sets: DataFrame, n: int) -> DataFrame:
    """The ``n`` most wasteful sets (at least one); ties are ordered by content."""
    return sets.orderBy(F.col("wasted_bytes").desc(), *CONTENT_KEY).limit(max(n, 1))


def of_chosen(rows: DataFrame, sets: DataFrame, most: int = MOST_LITERALS) -> DataFrame:
    """Rows that may belong to the sets: where these are few, a filter that the scan itself can use.

    Stored entries lie in the order of their hashes and have Bloom filters, so a scan for ten sets skips most
    row groups. With more than ``most`` sets the rows stay as they are, and the join that follows selects.
    """
    chosen = sets.select("content_hash").distinct().limit(most + 1).collect()
    if len(chosen) > most:
        return rows
    return rows.filter(F.col("content_hash").isin([row["content_hash"] for row in chosen]))


def locations(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Every copy of every set, one row each, so a set of any size stays distributed."""
    return rows.join(sets.select(*CONTENT_KEY), CONTENT_KEY, "left_semi").select(
        *CONTENT_KEY, "full_path"
    )


def sample_locations(rows: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The first ``k`` copies of each set in path order; ``k`` <= 0 keeps them all.

    Copies are ranked before the join, dealt by content, so the rows are shuffled once. Each task passes on
    at most ``k`` rows of a content, however common it is, for ``k`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by default). For a larger ``k`` they are first
    ranked within the content's path buckets, which deals one very common content over many tasks; the
    second rank then sees at most ``PATH_BUCKETS * k`` rows of it.
    """
    if k <= 0:
        return locations(rows, sets)
    key = ["packed", "size_bytes"]
    packed = text.packed_hash(F.col("content_hash")).alias("packed")
    first = rows.filter("content_hash is not null").select(packed, "size_bytes", "full_path")
    if k > int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        bucket = F.pmod(F.xxhash64("full_path"), F.lit(PATH_BUCKETS))
        in_bucket = Window.partitionBy(*key, "bucket").orderBy("full_path")
        first = first.withColumn("bucket", bucket).withColumn("position", F.row_number().over(in_bucket))
        first = first.filter(F.col("position") <= k).drop("bucket", "position")
    by_path = Window.partitionBy(*key).orderBy("full_path")
    ranked = first.withColumn("position", F.row_number().over(by_path)).filter(F.col("position") <= k)
    # Not a semi join: that would be done before the rows are ranked and cut.
    chosen = sets.select(packed, "size_bytes").distinct()
    return ranked.join(chosen, key).select(
        text.unpacked_hash(F.col("packed")).alias("content_hash"), "size_bytes", "full_path",
        F.col("position").cast("long").alias("position"),
    )


def copies_by_hash(entries: DataFrame) -> DataFrame:
    """Content seen more than once by hash alone, over every row given, largest total first."""
    return (
        entries.filter("content_hash is not null")
        .groupBy("content_hash")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.sum("size_bytes").cast("long").alias("total_bytes"),
        )
        .filter("copies > 1")
        .orderBy(F.col("total_bytes").desc(), "content_hash")
    )
