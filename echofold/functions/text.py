"""Rendering of sizes, dates, labels and report scalars as native Spark expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names in ascending powers of 1024.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]

HASH_PREFIX_CHARS = 12


def format_bytes(size: Column) -> Column:
    """``1536`` -> ``1.5 KB``: at most two decimals, trailing zeros dropped, plain bytes unscaled."""
    text = F.concat(size.cast("string"), F.lit(f" {UNITS[0]}"))
    for power, unit in enumerate(UNITS[1:], start=1):
        scaled = F.round(size / F.lit(float(1024**power)), 2).cast("string")
        scaled = F.regexp_replace(scaled, r"\.0$", "")
        text = F.when(size >= F.lit(1024**power), F.concat(scaled, F.lit(f" {unit}"))).otherwise(text)
    return text


def yaml_quote(text: Column) -> Column:
    """A YAML double-quoted scalar; the backslash is escaped first."""
    escapes = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
    escaped = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), escapes, text)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def display_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def name_or_label(name: Column, distinct_names: Column, label: str) -> Column:
    """The shared name, or a label when the copies are named differently."""
    return F.when(distinct_names == 1, name).otherwise(F.lit(label))


def hash_prefix(content_hash: Column) -> Column:
    return F.concat(F.substring(content_hash, 1, HASH_PREFIX_CHARS), F.lit("…"))


def remainder_note(total: Column, shown: Column) -> Column:
    """The note for copies that are not listed; null when all are."""
    return F.when(
        total > shown,
        F.concat(F.lit("… and "), (total - shown).cast("string"), F.lit(" more location(s)")),
    )


def error_text(error_type: Column, message: Column) -> Column:
    return F.concat_ws(": ", error_type, message)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def clock(seconds: Column) -> Column:
    """``hh:mm:ss`` within a day; whole days are not shown."""
    hours = F.pmod(F.floor(seconds / 3600), F.lit(24))
    minutes = F.pmod(F.floor(seconds / 60), F.lit(60))
    return F.format_string("%02d:%02d:%02d", hours, minutes, F.pmod(seconds, F.lit(60)))


def int64_le_hex(n: Column) -> Column:
    """A 64-bit integer as 16 hex digits, least significant byte first."""
    big_endian = F.lpad(F.hex(n), 16, "0")
    return F.lower(F.regexp_replace(F.reverse(big_endian), "(.)(.)", "$2$1"))


def packed_hash(value: Column) -> Column:
    """A hash as bytes, lower-case hex digits in half their length and any other text as it is; null for null.

    Hex digits hardly compress, so shuffles carry hashes in this form.
    """
    is_hex = F.coalesce(F.lower(F.hex(F.unhex(value))) == value, F.lit(False))
    return F.when(is_hex, F.concat(F.lit(b"\x01"), F.unhex(value))).otherwise(
        F.concat(F.lit(b"\x00"), F.encode(value, "UTF-8"))
    )


def unpacked_hash(packed: Column) -> Column:
    """The hash that ``packed_hash`` gave as bytes."""
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))
