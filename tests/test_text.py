import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from echofold.functions import text


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("size", "label"),
    [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1152, "1.13 KB"), (1048575, "1024 KB"),
     (100 << 20, "100 MB"), (3 << 29, "1.5 GB"), (1 << 40, "1 TB"), (5 << 60, "5120 PB")],
)
def test_format_bytes(spark, size, label):
    assert value(spark, text.format_bytes(F.lit(size).cast("long"))) == label


def test_yaml_quote_escapes_the_backslash_first(spark):
    assert value(spark, text.yaml_quote(F.lit('C:\\a "b"\n\r\t'))) == '"C:\\\\a \\"b\\"\\n\\r\\t"'


@pytest.mark.parametrize("n", [0, 1, 255, 256, 1 << 40, (1 << 63) - 1])
def test_little_endian_count(spark, n):
    assert value(spark, text.int64_le_hex(F.lit(n).cast("long"))) == struct.pack("<q", n).hex()


@pytest.mark.parametrize(("seconds", "shown"), [(0, "00:00:00"), (3661, "01:01:01"), (90061, "01:01:01")])
def test_clock_shows_the_time_within_a_day(spark, seconds, shown):
    assert value(spark, text.clock(F.lit(seconds).cast("long"))) == shown


def test_stamps(spark):
    ts = F.lit("2026-06-22 16:50:03").cast("timestamp_ntz")
    assert value(spark, text.iso_utc(ts)) == "2026-06-22T16:50:03Z"
    assert value(spark, text.file_stamp(ts)) == f"{datetime(2026, 6, 22, 16, 50, 3):%Y%m%d-%H%M%S}"
    assert value(spark, text.display_stamp(ts)) == "2026-06-22 16:50"


def test_labels(spark):
    assert value(spark, text.name_or_label(F.lit("a"), F.lit(1), "<differ>")) == "a"
    assert value(spark, text.name_or_label(F.lit("a"), F.lit(2), "<differ>")) == "<differ>"
    assert value(spark, text.hash_prefix(F.lit("0123456789abcdef"))) == "0123456789ab…"
    assert value(spark, text.remainder_note(F.lit(7), F.lit(5))) == "… and 2 more location(s)"
    assert value(spark, text.remainder_note(F.lit(5), F.lit(5))) is None
    assert value(spark, text.error_text(F.lit("IOException"), F.lit("gone"))) == "IOException: gone"


@pytest.mark.parametrize("kept", ["ab" * 32, "AB" * 32, "abc", "", "h1", "h1  ", "\x01", "é", None])
def test_a_packed_hash_unpacks_to_itself(spark, kept):
    row = spark.createDataFrame([(kept,)], "h string").select(text.packed_hash(F.col("h")).alias("p"))
    packed, again = row.select("p", text.unpacked_hash(F.col("p"))).first()
    assert again == kept
    if kept == "ab" * 32:
        assert len(packed) == 33
