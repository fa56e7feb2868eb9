"""Token-ID output: documents as Parquet rows of ids, and selective reads of them.

A file set has one row per document in ascending ``doc_id`` order: ``doc_id``, ``n_tokens``,
``ids_crc32`` and ``ids`` (list of int). The writer sets small pages and bounded row groups and the
second page format, so integers are delta-encoded where a dictionary does not pay, and column and
offset indexes are written. A read of the metadata columns never touches the page chunks of ``ids``;
a read of a ``doc_id`` range skips row groups and pages by their indexes.

Rows with a null ``doc_id`` come first, rows that tie in ``doc_id`` are ordered by text in the files and
by checksum and length in the digests, and a null text is an empty one. Other columns of the input are ignored. An empty table gives an empty file set.
"""

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.llm import tokens
from echofold.llm.batches import steps
from echofold.llm.tables import numbered, shared_path, stage

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1_000
# Rows of a block of the running sum.
BLOCK_ROWS = 1_024
SCHEMA = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32())),
])


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def encode_rows(
    batches: Iterator[pa.RecordBatch], path: str, blanks: bool, end_id: int
) -> Iterator[pa.RecordBatch]:
    encoder = tokens.encoder(path, blanks)
    for batch in batches:
        for part in steps(batch, "text", tokens.STEP_BYTES):
            ids, counts = encoder.encode(part.column("text"))
            with_end = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            offsets = np.concatenate([[0], np.cumsum(counts)])
            sums = [checksum(with_end[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(with_end.view("<i4")))
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(sums, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def write(docs: DataFrame, target: str, tokenizer: str, blanks: bool, end_id: int) -> None:
    """Encode ``docs`` and write the file set."""
    options = {
        "compression": "zstd",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
    }
    # Dealt out as text, which is smaller than its ids; every text is encoded once, in its place.
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    in_order = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encode = partial(encode_rows, path=tokenizer, blanks=blanks, end_id=end_id)
    in_order.mapInArrow(encode, SCHEMA).write.options(**options).parquet(target)


def read_metadata(spark: SparkSession, target: str) -> DataFrame:
    """Ids, lengths and checksums of the documents; the token pages stay unread."""
    return spark.read.schema(SCHEMA).parquet(target).drop("ids")


def read_tokens(spark: SparkSession, target: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Tokens of the documents with an id in a range; the bounds are pushed into the scan."""
    rows = spark.read.schema(SCHEMA).parquet(target)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(_ARROW)[:3])
    for batch in batches:
        lists = batch.column("ids")
        offsets = np.asarray(lists.offsets)
        ids = lists.values.to_numpy(zero_copy_only=False)
        sums = [checksum(ids[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        columns = [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def digests(stored: DataFrame) -> DataFrame:
    """From the stored ids: each document's start, number of tokens and checksum."""
    read = stored.select("doc_id", "ids").mapInArrow(_digests, "doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    read = stage(read, "digests")
    order = [F.col("doc_id"), F.col("ids_crc32"), F.col("n_tokens")]
    return running_start(read, order, "n_tokens", "start")


def running_start(rows: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """The sum of ``value`` over all rows before each one in a global order.

    Sums are taken inside blocks of consecutive rows and then over the blocks' totals, so no task
    sees more than a block or one number per block.
    """
    in_order = numbered(rows, order, "order").withColumn("block", F.floor(F.col("row_no") / BLOCK_ROWS))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = in_order.groupBy("block").agg(F.sum(value).alias("total"))
    totals = totals.withColumn("upper", F.floor(F.col("block") / BLOCK_ROWS))
    uppers = totals.groupBy("upper").agg(F.sum("total").alias("upper_total"))
    # A block of blocks holds a million rows: the last list is short at any size.
    wide = before.orderBy("upper")
    uppers = uppers.select("upper", F.coalesce(F.sum("upper_total").over(wide), F.lit(0)).alias("upper_start"))
    within = before.partitionBy("upper").orderBy("block")
    starts = totals.select("upper", "block", F.coalesce(F.sum("total").over(within), F.lit(0)).alias("block_start"))
    starts = starts.join(uppers, "upper").select("block", (F.col("block_start") + F.col("upper_start")).alias("b"))
    inner = before.partitionBy("block").orderBy("row_no")
    return (
        in_order.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(starts, "block")
        .withColumn(name, F.col("b") + F.col("_in"))
        .drop("block", "row_no", "_in", "b")
    )



def op5_token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write all documents' ids with end id 2 and report what the files hold."""
    import public_tokenizers

    target = shared_path(spark, "token-files")
    write(docs, target, public_tokenizers.path("word_bpe_49k.json"), blanks=False, end_id=2)
    found = digests(read_tokens(spark, target))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
