"""Reading the given tables, intermediate tables in the shared folder, and distributed row numbers."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.staging import staging_root

# What separates words: the ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Size of the bitmap that tells which rows are wanted.
BITMAP_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder named by ``spark.checkpoint.dir``, else in a warehouse that is shared."""
    return f"{staging_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only_wanted(rows: DataFrame, wanted: DataFrame, key: str, wanted_key: str | None = None) -> DataFrame:
    """Rows whose ``key`` may be among ``wanted`` (its ``wanted_key``), by a broadcast bitmap of at most 2 MB.

    It keeps rows with long texts from being moved for nothing. The caller joins what is left; a
    larger table only lets more rows through, never fewer.
    """
    spot, wanted_spot = (F.pmod(F.xxhash64(k), F.lit(BITMAP_BITS)) for k in (key, wanted_key or key))
    bits = wanted.select(wanted_spot.alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("_bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bitmap"))
    marked = rows.withColumn("_spot", spot).withColumn("_bucket", F.bitmap_bucket_number("_spot"))
    place = F.bitmap_bit_position("_spot")
    marked = marked.join(F.broadcast(bits), "_bucket").withColumn("_place", place.cast("int"))
    byte = F.conv(F.hex(F.expr("substring(_bitmap, _place div 8 + 1, 1)")), 16, 10).cast("int")
    marked = marked.withColumn("_byte", byte)
    return marked.filter(F.expr("shiftright(_byte, _place % 8) & 1 = 1")).select(*rows.columns)


def numbered(df: DataFrame, order: list[Column], name: str, row: str = "row_no") -> DataFrame:
    """Staged rows with their position from 0 in a global order.

    Rows are dealt by range, so no task holds more than its share; inside a partition the engine's
    increasing id is the position, and one count per partition gives where each begins. Rows that
    tie in ``order`` get neighboring numbers.
    """
    local = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = stage(dealt.withColumn("_local", local), name)
    # The id is the partition's number above 33 bits of position.
    part = F.shiftright("_local", 33).cast("int")
    counted = staged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One number per partition: a bounded list, whatever the rows.
    starts, total = [], 0
    for r in sorted(counted.collect()):
        starts.append((r["_part"], total))
        total += r["_rows"]
    begins = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    inside = F.col("_local").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        staged.withColumn("_part", part)
        .join(F.broadcast(begins), "_part")
        .withColumn(row, F.col("_start") + inside)
        .drop("_part", "_start", "_local")
    )
