"""Inventories derived from the given tables.

Every document is a file of its source's drive and of a backup drive. Each drive has an old, a newest,
a canceled and a running run; documents labelled toxic could not be read in the newest one. Web pages
make up a run that the log does not know. Every line item is a file of a larger, deeper inventory.

Documents are also written as files of their own, beneath one folder per source, for the queries that list
and read storage.
"""

import os
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold import schemas as S
from echofold.functions import paths
from echofold.operators.folders import folder_rows
from echofold.operators.runs import current_entries, hashed, latest_runs
from echofold.sources import storage
from echofold.sources.listing import listing_from_table
from echofold.staging import new_path, stage

LOCKED = "IOException: file locked"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes_after(start: str, minutes: str) -> Column:
    return F.expr(f"timestamp_ntz'{start}' + make_dt_interval(0, 0, int({minutes}), 0)")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the path, dates and flags of the file each stands for."""
    flags = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        (F.max("toxic") == 1).alias("unreadable"), (F.min("quality") == 0).alias("is_link")
    )
    return (
        table(spark, sf_dir, "documents")
        .join(flags, "doc_id", "left")
        .select(
            "doc_id", "source", "lang", "text",
            F.expr("concat('s3://', source, '/')").alias("drive"),
            F.expr(
                "concat('s3://', source, '/', lang, '/b', doc_id div 20 % 5, '/doc_', doc_id, '.txt')"
            ).alias("path"),
            _minutes_after("2023-01-01 00:00:00", "doc_id").alias("modified"),
            _minutes_after("2022-01-01 00:00:00", "n_chars").alias("created"),
            F.coalesce("unreadable", F.lit(False)).alias("unreadable"),
            F.coalesce("is_link", F.lit(False)).alias("is_link"),
        )
    )


def document_listing(
    spark: SparkSession, sf_dir: str, max_hash_bytes: int = 0, keep: tuple[str, ...] = ()
) -> DataFrame:
    return listing_from_table(
        documents(spark, sf_dir), path="path", root="drive", content="text",
        modified="modified", created="created", max_hash_bytes=max_hash_bytes, keep=keep,
    )


def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn(
        "modified", _minutes_after("2023-06-01 00:00:00", "page_id")
    )
    return listing_from_table(pages, path="url", content="html", modified="modified")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs per source, one of the backup drive, and one without a drive."""
    outcomes = F.array(*[F.lit(s) for s in (S.COMPLETED, S.COMPLETED, S.CANCELED, S.RUNNING)])
    per_source = (
        table(spark, sf_dir, "documents").select("source").distinct()
        .select("source", F.posexplode(outcomes).alias("k", "status"))
        .selectExpr(
            "concat('r-', source, '-', k) as scan_run_id",
            "concat('s3://', source, '/') as drive",
            "status",
            """case when k = 3 then null
                    when k = 0 and source <> 'src7' then timestamp_ntz'2024-01-01 01:00:00'
                    when k = 2 then timestamp_ntz'2024-01-03 01:30:15'
                    else timestamp_ntz'2024-01-02 01:00:00' end as completed_at_utc""",
        )
    )
    backup = spark.sql(
        """select 'r-backup-1' as scan_run_id, 's3://backup/' as drive, 'Completed' as status,
                  timestamp_ntz'2024-01-02 01:00:00' as completed_at_utc
           union all
           select 'r-nodrive', null, 'Completed', timestamp_ntz'2024-01-05 01:00:00'"""
    )
    return per_source.unionByName(backup).withColumn(
        "started_at_utc", F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    )


def file_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows of every run. Each document is read and hashed once for its four runs."""
    docs = document_listing(spark, sf_dir, keep=("source", "unreadable"))
    per_run = F.expr(
        f"""inline(array(
            named_struct('scan_run_id', concat('r-', source, '-0'), 'path', full_path,
                         'hash', content_hash, 'scan_error', cast(null as string)),
            named_struct('scan_run_id', concat('r-', source, '-1'), 'path', full_path,
                         'hash', if(unreadable, null, content_hash),
                         'scan_error', if(unreadable, '{LOCKED}', null)),
            named_struct('scan_run_id', concat('r-', source, '-2'), 'path', full_path,
                         'hash', cast(null as string), 'scan_error', cast(null as string)),
            named_struct('scan_run_id', 'r-backup-1', 'path', concat('s3://backup/old/', substr(full_path, 6)),
                         'hash', content_hash, 'scan_error', cast(null as string))))"""
    )
    described = ["file_name", "size_bytes", "date_modified_utc", "date_created_utc"]
    of_documents = docs.select(*described, per_run)
    of_pages = page_listing(spark, sf_dir).select(
        *described, F.lit("r-ghost").alias("scan_run_id"), F.col("full_path").alias("path"),
        F.col("content_hash").alias("hash"), F.lit(None).cast("string").alias("scan_error"),
    )
    return of_documents.unionByName(of_pages).select(
        "scan_run_id", F.lit(S.FILE).alias("entry_type"), "file_name", F.col("path").alias("full_path"),
        "size_bytes", "date_modified_utc", "date_created_utc", F.col("hash").alias("content_hash"), "scan_error",
    )


def skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    denied = table(spark, sf_dir, "documents").filter("lang <> 'en'").select("source", "lang").distinct()
    return denied.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).selectExpr(
        "concat('s3://', source, '/', lang, '/denied') as full_path",
        "'UnauthorizedAccessException: access denied' as reason",
        "concat('r-', source, '-', k) as scan_run_id",
    )


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(file_entries(spark, sf_dir), "files")


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and folder rows of every run, as an inventory job leaves them."""
    files = stored_files(spark, sf_dir)
    return files.unionByName(stage(folder_rows(files), "folders"))


def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = latest_runs(scans(spark, sf_dir))
    return hashed(current_entries(file_entries(spark, sf_dir), runs, S.FILE))


def current_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the current runs, fingerprinted where another folder may have the same content."""
    runs = latest_runs(scans(spark, sf_dir))
    files = stage(current_entries(file_entries(spark, sf_dir), runs, S.FILE), "current-files")
    return stage(hashed(folder_rows(files, repeated_only=True)), "current-folders")


def lineitem_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per line item under three roots, two of which hold most of them."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'r-lines' as scan_run_id",
        "'F' as entry_type",
        "concat('l', l_linenumber, '_', l_partkey, '_', l_suppkey) as file_name",
        """concat('s3://', lower(l_returnflag), '/', year(l_shipdate), '/', month(l_shipdate), '/o',
                  l_orderkey, '/l', l_linenumber, '_', l_partkey, '_', l_suppkey) as full_path""",
        "cast(l_quantity as bigint) * 1024 as size_bytes",
        "l_shipdate as date_modified_utc",
        "cast(null as timestamp_ntz) as date_created_utc",
        "sha2(concat_ws('|', l_partkey, cast(l_quantity as bigint)), 256) as content_hash",
        "cast(null as string) as scan_error",
    )


def lineitem_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folder_rows(stage(lineitem_files(spark, sf_dir), "line-files"), repeated_only=True)


def event_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long run log: one run per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('e', event_id) as scan_run_id",
        "case when user_id >= 145 then null else concat('s3://u', user_id, '/') end as drive",
        """case event_type when 'error' then 'Failed' when 'signup' then 'Running'
                           when 'click' then 'Canceled' else 'Completed' end as status""",
        "ts as started_at_utc",
        "case when event_type <> 'signup' then ts end as completed_at_utc",
    )


def link_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and their language folders; low-quality documents are link files, ``fr`` a link folder."""
    docs = documents(spark, sf_dir)
    files = docs.select(F.col("path").alias("full_path"), F.lit(False).alias("is_dir"), "is_link")
    folders = docs.selectExpr(
        "concat('s3://', source, '/', lang) as full_path", "true as is_dir", "lang = 'fr' as is_link"
    ).distinct()
    return files.unionByName(folders)


def failing_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files, and one directory per non-English language that could not be listed."""
    docs = documents(spark, sf_dir)
    files = docs.select(
        F.col("drive").alias("root"), F.col("path").alias("full_path"),
        F.lit(None).cast("string").alias("list_error_type"), F.lit(None).cast("string").alias("list_error"),
    )
    denied = docs.filter("lang <> 'en'").selectExpr(
        "drive as root", "concat(drive, lang, '/denied') as full_path",
        "'UnauthorizedAccessException' as list_error_type", "'access denied' as list_error",
    ).distinct()
    return files.unionByName(denied)


def sized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's path in four styles, with the folders above it in each."""
    docs = documents(spark, sf_dir).select("path")
    tail = F.expr("substr(path, 6)")
    backslashed = F.translate(tail, "/", "\\")
    styles = F.array(
        F.col("path"),
        F.concat(F.lit("/"), tail),
        F.concat(F.lit("C:\\"), backslashed),
        F.concat(F.lit("\\\\srv\\share\\"), backslashed),
        paths.root_of("path"),
    )
    return docs.select(F.explode(styles).alias("path"))


@contextmanager
def few_rows_a_batch(spark: SparkSession, most: int = 100) -> Iterator[None]:
    """Python tasks of the jobs inside hold at most so many rows at a time, for rows with whole contents."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _write_files(batches: Iterable[pd.DataFrame], links: bool) -> Iterator[pd.DataFrame]:
    """Write each row's content under its path; ``links`` makes links to ``content`` instead."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            name = storage.bytes_of(storage.local_name(path))
            os.makedirs(os.path.dirname(name), exist_ok=True)
            if links:
                # A task that is run again finds its link.
                if not os.path.islink(name):
                    os.symlink(storage.bytes_of(storage.local_name(content)), name)
            else:
                with open(name, "wb") as file:
                    file.write(content)
        yield batch[["path"]]


def written_documents(spark: SparkSession, sf_dir: str) -> str:
    """A shared folder in which every document is a file ``<source>/<lang>/<name>``, written by tasks.

    Some names are hidden, hold URI marks, or are not UTF-8 (the private character is the byte 0xFF).
    Every source's folder links to the next one's, the last to the first, so links run in a circle.
    Spanish documents lie outside, where only links lead to. Some files have links to them besides.
    """
    base, outside = (storage.full_form(new_path(spark, name)) for name in ("documents", "documents-outside"))
    file = F.expr(
        """case doc_id % 10 when 3 then concat('doc_', '\uefff', doc_id) when 4 then concat('.doc_', doc_id)
                            when 5 then concat('doc #%20 ', doc_id) else concat('doc_', doc_id, '.txt') end"""
    )
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.encode("text", "UTF-8").alias("content"),
        F.concat_ws("/", F.when(F.col("lang") == "es", outside).otherwise(base), "source", "lang", file).alias("path"),
    )
    with few_rows_a_batch(spark):
        stage(docs.select("path", "content").mapInPandas(partial(_write_files, links=False), "path string"), "written")

    sources = docs.select("source").distinct()
    following = sources.agg(F.array_sort(F.collect_list("source")).alias("all"))
    circle = sources.crossJoin(F.broadcast(following)).select(
        F.concat_ws("/", F.lit(base), "source", F.lit("next")).alias("path"),
        F.concat(F.lit(f"{base}/"), F.expr("element_at(all, int(array_position(all, source) % size(all) + 1))")).alias("content"),
    )
    spanish = docs.filter("lang = 'es'").select("source").distinct().select(
        F.concat_ws("/", F.lit(base), "source", F.lit("es")).alias("path"),
        F.concat_ws("/", F.lit(outside), "source", F.lit("es")).alias("content"),
    )
    again = docs.filter("doc_id % 10 = 0 and lang <> 'es'").select(
        F.concat("path", F.lit(".link")).alias("path"), F.col("path").alias("content")
    )
    links = circle.unionByName(spanish).unionByName(again)
    stage(links.mapInPandas(partial(_write_files, links=True), "path string"), "linked")
    return base


def beneath(rows: DataFrame, base: str) -> DataFrame:
    """``full_path`` from the given folder on."""
    return rows.withColumn("full_path", F.substr(F.col("full_path"), F.lit(len(base) + 2)))
