"""A filter that keeps rows without a partner in another table from being moved for a join."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Size of the bitmap that tells which keys are wanted.
BITMAP_BITS = 1 << 27


def mark_among(rows: DataFrame, key: Sequence[str], wanted: DataFrame, wanted_key: Sequence[str]) -> DataFrame:
    """Rows with ``_among``: whether their key may be among the ``wanted`` ones; never false where it is.

    The test is a broadcast bitmap of at most 16 MB. More wanted keys only make more rows pass, so the
    caller joins those. Keys must have the same types on both sides.
    """
    wanted_spot = F.pmod(F.xxhash64(*wanted_key), F.lit(BITMAP_BITS)).alias("_spot")
    bits = wanted.select(wanted_spot).groupBy(F.bitmap_bucket_number("_spot").alias("_bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bitmap"))
    marked = rows.withColumn("_spot", F.pmod(F.xxhash64(*key), F.lit(BITMAP_BITS)))
    marked = marked.withColumn("_bucket", F.bitmap_bucket_number("_spot")).join(F.broadcast(bits), "_bucket", "left")
    marked = marked.withColumn("_place", F.bitmap_bit_position("_spot").cast("int"))
    byte = F.conv(F.hex(F.expr("substring(_bitmap, _place div 8 + 1, 1)")), 16, 10).cast("int")
    among = F.coalesce(F.expr("shiftright(_byte, _place % 8) & 1 = 1"), F.lit(False))
    return marked.withColumn("_byte", byte).select(*rows.columns, among.alias("_among"))


def maybe_among(rows: DataFrame, key: Sequence[str], wanted: DataFrame, wanted_key: Sequence[str]) -> DataFrame:
    """Rows whose key may be among the ``wanted`` ones."""
    return mark_among(rows, key, wanted, wanted_key).filter("_among").drop("_among")
