"""The complete report of duplicate sets, and the ranked preview."""

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions import text
from echofold.plans.analysis import DuplicateAnalysis
from echofold.schemas import CONTENT_KEY
from echofold.sources.store import ntz

FILES_DIFFER = "<filenames differ>"
FOLDERS_DIFFER = "<folder names differ>"

# The report's section keys in order.
_SECTIONS = ["scans", "duplicateFileSets", "duplicateFolderSets"]


def _names_differ() -> Column:
    return F.col("distinct_name_count") > 1


def report_sets(analysis: DuplicateAnalysis) -> DataFrame:
    """One row per set; the name is null when the copies are named differently."""
    def section(name: str, sets: DataFrame) -> DataFrame:
        return sets.select(
            F.lit(name).alias("section"),
            F.when(~_names_differ(), F.col("file_name")).alias("name"),
            _names_differ().alias("names_differ"),
            *CONTENT_KEY, "copy_count", "wasted_bytes",
        )

    return section("files", analysis.file_sets).unionByName(section("folders", analysis.folder_sets))


def report_locations(analysis: DuplicateAnalysis) -> DataFrame:
    """One row per copy of each set."""
    def section(name: str, found: DataFrame) -> DataFrame:
        return found.select(F.lit(name).alias("section"), *CONTENT_KEY, "full_path")

    return section("files", analysis.file_locations).unionByName(
        section("folders", analysis.folder_locations)
    )


def _block(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _pair(indent: str, key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{indent}{key}: "), value.cast("string"))


def _lines(
    rows: DataFrame, section: int, line: Column, part: int = 0, of_set: bool = False,
    path: str | None = None,
) -> DataFrame:
    """Text blocks with the columns that order them; those that do not apply are null."""
    def column(name: str | None, kind: str) -> Column:
        return (F.col(name) if name else F.lit(None)).cast(kind)

    return rows.select(
        F.lit(section).cast("long").alias("section"),
        column("wasted_bytes" if of_set else None, "long").alias("wasted_bytes"),
        column("content_hash" if of_set else None, "string").alias("content_hash"),
        column("size_bytes" if of_set else None, "long").alias("size_bytes"),
        F.lit(part).cast("long").alias("part"),
        column(path, "string").alias("full_path"),
        line.alias("line"),
    )


def _section_key(rows: DataFrame, section: int) -> DataFrame:
    key = _SECTIONS[section - 1]
    found = rows.agg(F.count(F.lit(1)).alias("n"))
    return _lines(found, section, F.when(F.col("n") == 0, f"{key}: []").otherwise(f"{key}:"))


def _set_lines(sets: DataFrame, found: DataFrame, section: int) -> DataFrame:
    head = _block(
        _pair("  - ", "name", F.when(_names_differ(), "null").otherwise(text.yaml_quote(F.col("file_name")))),
        _pair("    ", "namesDiffer", _names_differ()),
        _pair("    ", "contentHash", text.yaml_quote(F.col("content_hash"))),
        _pair("    ", "sizeBytes", F.col("size_bytes")),
        _pair("    ", "copyCount", F.col("copy_count")),
        _pair("    ", "wastedBytes", F.col("wasted_bytes")),
        F.lit("    locations:"),
    )
    place = F.concat(F.lit("      - "), text.yaml_quote(F.col("full_path")))
    placed = found.join(sets.select(*CONTENT_KEY, "wasted_bytes"), CONTENT_KEY)
    return _lines(sets, section, head, part=1, of_set=True).unionByName(
        _lines(placed, section, place, part=2, of_set=True, path="full_path")
    )


def yaml_lines(analysis: DuplicateAnalysis, min_wasted: int, generated_utc: datetime) -> DataFrame:
    """The report as text blocks with the columns that order them.

    A set's copies are rows of their own, so sorting spreads even one huge set over many tasks.
    """
    floor = F.lit(min_wasted).cast("long")
    head = _block(
        F.lit("# Duplicate files and folders."),
        F.concat(
            F.lit("# Sets that waste less are left out: "), text.format_bytes(floor),
            F.lit(f" ({min_wasted} bytes)."),
        ),
        F.lit(""),
        _pair("", "generatedUtc", text.yaml_quote(text.iso_utc(ntz(generated_utc)))),
        _pair("", "wastedSpaceThresholdBytes", floor),
        _pair("", "totalWastedBytes", F.col("total_wasted_bytes")),
    )
    scan = _block(
        _pair("  - ", "drive", text.yaml_quote(F.col("drive"))),
        _pair("    ", "scanRunId", text.yaml_quote(F.col("scan_run_id"))),
        _pair("    ", "completedUtc", text.yaml_quote(text.iso_utc(F.col("completed_at_utc")))),
    )
    parts = [
        _lines(analysis.total, 0, head),
        _section_key(analysis.scans, 1),
        _lines(analysis.scans, 1, scan, part=1, path="drive"),
        _section_key(analysis.file_sets, 2),
        _set_lines(analysis.file_sets, analysis.file_locations, 2),
        _section_key(analysis.folder_sets, 3),
        _set_lines(analysis.folder_sets, analysis.folder_locations, 3),
    ]
    return reduce(DataFrame.unionByName, parts)


def in_report_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy(
        "section",
        # A section's key has no waste and comes before its sets.
        F.col("wasted_bytes").desc_nulls_first(),
        F.col("content_hash").asc_nulls_first(),
        F.col("size_bytes").asc_nulls_first(),
        "part",
        F.col("full_path").asc_nulls_first(),
    )


def write_report(
    analysis: DuplicateAnalysis, path: str, min_wasted: int, generated_utc: datetime
) -> None:
    """Write ``report.yml`` (parts in order), and the sets and copies as JSON beside it."""
    lines = in_report_order(yaml_lines(analysis, min_wasted, generated_utc))
    lines.select("line").write.text(f"{path}/report.yml")
    report_sets(analysis).write.json(f"{path}/sets")
    report_locations(analysis).write.json(f"{path}/locations")


def report_name(generated_utc: datetime) -> str:
    return f"duplicates-{generated_utc:%Y%m%d-%H%M%S}"


def _padded(pad: Callable[..., Column], value: Column, width: int) -> Column:
    """Padded to a width, never cut."""
    return pad(value, F.greatest(F.length(value), F.lit(width)), F.lit(" "))


def preview(sets: DataFrame, samples: DataFrame, label: str) -> DataFrame:
    """The ranked top sets as display text: headline, sampled copies, and how many are not shown.

    Meant for the bounded output of a top-n analysis with a positive sample size: ranking it needs
    one partition, and a set's sampled copies become one value.
    """
    shown = samples.groupBy(*CONTENT_KEY).agg(
        F.array_sort(F.collect_list("full_path")).alias("paths"), F.count(F.lit(1)).alias("shown")
    )
    rank = F.row_number().over(Window.orderBy(F.col("wasted_bytes").desc(), *CONTENT_KEY)).cast("long")
    ranked = sets.withColumn("rank", rank).join(shown, CONTENT_KEY, "left")
    name = text.name_or_label(F.col("file_name"), F.col("distinct_name_count"), label)
    headline = F.concat(
        F.lit("#"), _padded(F.rpad, F.col("rank").cast("string"), 2), F.lit(" "),
        _padded(F.lpad, text.format_bytes(F.col("wasted_bytes")), 11), F.lit(" wasted  |  "), name,
        F.lit("  |  "), F.col("copy_count").cast("string"), F.lit(" copies × "),
        text.format_bytes(F.col("size_bytes")), F.lit("  |  hash "), text.hash_prefix(F.col("content_hash")),
    )
    return ranked.select(
        "rank",
        headline.alias("headline"),
        F.array_join("paths", "\n").alias("locations"),
        text.remainder_note(F.col("copy_count"), F.col("shown")).alias("remainder"),
    )
