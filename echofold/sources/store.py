"""The stored inventory as Parquet: entries and skips by run, an append-only run log, and hashing in progress."""

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echofold import schemas as S
from echofold.operators import runs


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def ntz(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


# Columns that are compared as keys; tables with fixed-width columns pad them.
_KEYS = {"scan_run_id", "content_hash"}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in order; absent ones are null, and keys have no blanks at their end."""
    def column(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None)
        return F.rtrim(name) if name in _KEYS else F.col(name)

    return df.select(*[column(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class Inventory:
    """Where one inventory lives."""

    spark: SparkSession
    base: str

    def _path(self, table: str) -> str:
        return f"{self.base.rstrip('/')}/{table}"

    def _read(self, table: str, schema: StructType) -> DataFrame | None:
        try:
            found = self.spark.read.schema(schema).parquet(self._path(table))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return found.select(*schema.names)

    def _read_or_empty(self, table: str, schema: StructType) -> DataFrame:
        found = self._read(table, schema)
        return self.spark.createDataFrame([], schema) if found is None else found

    def entries(self) -> DataFrame:
        return self._live(self._read_or_empty("entries", S.ENTRIES))

    def skips(self) -> DataFrame:
        return self._live(self._read_or_empty("skips", S.SKIPS))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of runs that the version of this moment does not drop."""
        dropped = self.dropped_runs()
        return rows if dropped is None else rows.join(dropped, "scan_run_id", "left_anti").select(*rows.columns)

    def _commits(self) -> list[str]:
        """Names of the committed versions, oldest first."""
        place = self._hadoop().Path(self._path("commits"))
        files = place.getFileSystem(self._conf())
        if not files.exists(place):
            return []
        names = (status.getPath().getName() for status in files.listStatus(place))
        return sorted(name for name in names if name.isdigit())

    def dropped_runs(self) -> DataFrame | None:
        """Runs that the newest version drops (scan_run_id); null before the first cleanup in place."""
        versions = self._commits()
        if not versions:
            return None
        (list_name,) = self.spark.read.text(f"{self._path('commits')}/{versions[-1]}").first()
        return self.spark.read.schema("scan_run_id string").parquet(self._path(f"dropped/{list_name}"))

    def commit_dropped(self, runs: DataFrame) -> None:
        """Make a version that drops these runs as well, all at once.

        The list is written first, then a file that names it, which one rename puts in its place. Before the
        rename nothing has changed, and after it every new read sees the new version; frames that were
        made before keep the old one. If two cleanups meet, the second one's rename fails.
        """
        versions, before = self._commits(), self.dropped_runs()
        listed = runs.select("scan_run_id") if before is None else runs.select("scan_run_id").union(before)
        name = uuid.uuid4().hex
        listed.distinct().write.parquet(self._path(f"dropped/{name}"))
        hadoop, conf = self._hadoop(), self._conf()
        target = hadoop.Path(f"{self._path('commits')}/{len(versions) + 1:010d}")
        written = hadoop.Path(f"{self._path('commits')}/_{name}")
        with_name = written.getFileSystem(conf).create(written, False)
        with_name.write(bytearray(name.encode()))
        with_name.close()
        never_replace = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        never_replace[0] = hadoop.Options.Rename.NONE
        context = hadoop.FileContext.getFileContext(written.getFileSystem(conf).getUri(), conf)
        context.rename(context.makeQualified(written), context.makeQualified(target), never_replace)

    def vacuum(self) -> None:
        """Delete the folders of dropped runs, one per run and table; readers of older versions must be done."""
        dropped = self.dropped_runs()
        if dropped is None:
            return
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in dropped.toLocalIterator():
            for table in ("entries", "skips"):
                place = self._hadoop().Path(f"{self._path(table)}/scan_run_id={escape(row['scan_run_id'])}")
                place.getFileSystem(self._conf()).delete(place, True)

    def _hadoop(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def scan_events(self) -> DataFrame:
        return self._read_or_empty("scan_events", S.SCAN_EVENTS)

    def has_log(self) -> bool:
        return self._read("scan_events", S.SCAN_EVENTS) is not None

    def scans(self) -> DataFrame:
        """The run log, one row per run."""
        return runs.latest_state(self.scan_events())

    def create(self, recreate: bool = False) -> None:
        """Create missing tables; ``recreate`` empties entries and skips but never the run log."""
        for table, schema, by, kept in [
            ("entries", S.ENTRIES, ["scan_run_id", "entry_type"], False),
            ("skips", S.SKIPS, ["scan_run_id"], False),
            ("scan_events", S.SCAN_EVENTS, [], True),
        ]:
            missing = self._read(table, schema) is None
            if missing or (recreate and not kept):
                empty = self.spark.createDataFrame([], schema)
                writer = empty.write.mode("overwrite").option("partitionOverwriteMode", "static")
                writer.partitionBy(*by).parquet(self._path(table))

    def write_entries(self, rows: DataFrame, replace: bool = False) -> None:
        """Append rows, or replace the partitions (run, type) they belong to.

        The rebalance hint gives every partition files of the advisory size and splits a run that
        holds most of the rows over many tasks. Inside a file rows lie in the order of their hashes, and the
        hashes have a Bloom filter, for reading the copies of few contents.
        """
        shaped = conform(rows, S.ENTRIES).hint("rebalance", "scan_run_id", "entry_type")
        shaped = shaped.sortWithinPartitions("scan_run_id", "entry_type", "content_hash")
        writer = shaped.write.mode("overwrite" if replace else "append")
        writer = writer.option("parquet.bloom.filter.enabled#content_hash", "true")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(
            "scan_run_id", "entry_type"
        ).parquet(self._path("entries"))

    def write_skips(self, rows: DataFrame, replace: bool = False) -> None:
        """Append rows, or replace those of their runs."""
        shaped = conform(rows, S.SKIPS).hint("rebalance", "scan_run_id")
        writer = shaped.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("scan_run_id").parquet(self._path("skips"))

    def progress(self, batch: str) -> DataFrame:
        return self._read_or_empty("progress", S.PROGRESS).filter(F.col("batch") == batch)

    def write_progress(self, batch: str, step: str, *numbers: int) -> None:
        """Mark a step as finished, for all the numbers at once."""
        rows = self.spark.createDataFrame([(batch, step, n, utc_now()) for n in numbers], S.PROGRESS)
        rows.coalesce(1).write.mode("append").parquet(self._path("progress"))

    def failures(self, batch: str) -> DataFrame:
        """Runs whose listing failed: scan_run_id, error."""
        found = self._read_or_empty("failures", S.FAILURES).filter(F.col("batch") == batch)
        return found.select("scan_run_id", "error")

    def write_failures(self, rows: DataFrame, batch: str) -> None:
        shaped = conform(rows.withColumn("batch", F.lit(batch)), S.FAILURES).repartition("batch")
        writer = shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch").parquet(self._path("failures"))

    def finished(self, batch: str) -> DataFrame:
        """The buckets that are finished: bucket."""
        done = self.progress(batch).filter(F.col("step") == S.HASHED)
        return done.select(F.col("number").alias("bucket")).distinct()

    def hashes(self, batch: str) -> DataFrame:
        """Hash results of the buckets that are finished."""
        found = self._read_or_empty("hashes", S.HASHES).filter(F.col("batch") == batch)
        return found.join(self.finished(batch), "bucket", "left_semi").drop("batch", "bucket")

    def write_hashes(self, rows: DataFrame, batch: str) -> None:
        """Store the results of buckets, in place of what an interrupted attempt may have left."""
        shaped = conform(rows.withColumn("batch", F.lit(batch)), S.HASHES).hint("rebalance", "bucket")
        writer = shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch", "bucket").parquet(self._path("hashes"))

    def write_events(self, rows: DataFrame) -> None:
        conform(rows, S.SCAN_EVENTS).write.mode("append").parquet(self._path("scan_events"))
