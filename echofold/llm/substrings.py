"""Exact substring dedup by sorting suffixes at content-chosen places.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts elsewhere. Not every suffix
needs sorting: of each window of that length, the ``GRAM``-byte string with the least hash is its anchor
(the first of equal ones), and equal windows have equal anchors at equal places. So only suffixes that
start at anchors are candidates, about one in 85 bytes, and of these only the ones whose leading bytes
occur more than once.

These suffixes are range-partitioned by their leading bytes. The splitters are quantiles of the
leading bytes of all repeated anchors, so buckets hold about equal numbers of rows; equal leading bytes are
never separated, which leaves nothing to compare across a boundary but the splitters' own keys. In a
bucket, suffixes are sorted by multikey quicksort, eight bytes as a character, each
further character only among rows that tie, and neighbors with equal leading bytes form groups. Inside a group,
all windows of its anchors are compared by a hash of their whole text; a window met twice is repeated.
A suffix carries the bytes before and behind it that any of its windows can reach, so no text is
looked up.

A null text is an empty one, and texts below the length keep everything. Rows that repeat both
``doc_id`` and text hold each other's strings, so they lose all if long enough. A null ``doc_id`` is
kept. Other columns are ignored; an empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.batches import steps
from echofold.llm.tables import BITMAP_BITS, stage

LENGTH = 200
GRAM = 32
# Rows of a bucket, about, and the largest number of buckets.
BUCKET_ROWS, MOST_BUCKETS = 8_000, 1 << 15
_STEP_BYTES = 1 << 20
_CHUNK_ROWS = 8_000
_SPAN = LENGTH - GRAM + 1
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE_VALUES = np.random.default_rng(0).integers(1, 1 << 63, 256, dtype=np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number that sorts as they do."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data),), dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading word and hash of the string of GRAM bytes from each position on."""
    words = _words(data)
    h = np.zeros(len(data), dtype=np.uint64)
    for i, factor in enumerate(_FACTORS):
        h[: len(data) - 8 * i] += words[8 * i :] * factor if i else words * factor
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return words, h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, borders: np.ndarray):
    """Anchors of all windows of the texts between ``borders``.

    Returns text number, position in ``data``, least and largest distance to the start of a window it
    anchors, leading word and hash.
    """
    lengths = np.diff(borders)
    windows = np.maximum(lengths - LENGTH + 1, 0)
    if not windows.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    words, h = _grams(data)
    # Position in the low bits: the least key is the first of equal hashes.
    mask = np.uint64((1 << max(1, int(len(data)).bit_length())) - 1)
    key = (h & ~mask) | np.arange(len(data), dtype=np.uint64)
    low, width = key, 1
    while 2 * width <= _SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(data) - _SPAN + 1], low[_SPAN - width : _SPAN - width + len(data) - _SPAN + 1])
    text = np.repeat(np.arange(len(lengths)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + borders[:-1][text]
    at = (low[start] & mask).astype(np.int64)
    first = np.ones(len(at), dtype=bool)
    first[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(at)) - 1
    own = at[begin]
    return text[begin], own, own - start[end], own - start[begin], words[own], h[own]


def _bytes_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(part.column("text").cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _spot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)


def _signed(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones in the same order."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text", _STEP_BYTES):
            *_, lead, h = anchors(*_bytes_of(part))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(lead)), pa.array(h.view(np.int64))], names=["lead", "h"])


def _suffix_rows(batches: Iterator[pa.RecordBatch], repeated, splitters) -> Iterator[pa.RecordBatch]:
    """Suffixes at anchors that may be repeated, with the LENGTH bytes before and behind their start."""
    bits, borders_of = repeated.value, splitters.value
    around = np.arange(-LENGTH, LENGTH)
    for batch in batches:
        for part in steps(batch, "text", _STEP_BYTES):
            data, borders = _bytes_of(part)
            text, at, near, far, lead, h = anchors(data, borders)
            spot = _spot(h)
            keep = (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
            text, at, near, far, lead, h = (x[keep] for x in (text, at, near, far, lead, h))
            padded = np.concatenate([np.zeros(LENGTH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
            context = padded[(at + LENGTH)[:, None] + around]
            lead = _signed(lead)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.searchsorted(borders_of, lead, side="right"), pa.int32()),
                part.column("doc_id").take(pa.array(text)), part.column("text_hash").take(pa.array(text)),
                pa.array(at - borders[text], pa.int64()), pa.array(near, pa.int32()), pa.array(far, pa.int32()),
                pa.Array.from_buffers(pa.binary(), len(at), [
                    None, pa.py_buffer((np.arange(len(at) + 1) * 2 * LENGTH).astype(np.int32)),
                    pa.py_buffer(np.ascontiguousarray(context)),
                ]),
            ], names=["bucket", "doc_id", "text_hash", "at", "near", "far", "context"])


def sort_suffixes(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: order of the rows, and for each whether it ties with the one before in all words.

    Rows are sorted by one word at a time; only runs that tie so far are sorted by the next.
    """
    n = len(words[0])
    order = np.argsort(words[0], kind="stable")
    ties = np.zeros(n, dtype=bool)
    ties[1:] = words[0][order[1:]] == words[0][order[:-1]]
    for word in words[1:]:
        inside = ties.copy()
        inside[:-1] |= ties[1:]
        rows = np.flatnonzero(inside)
        if not len(rows):
            break
        run = np.cumsum(~ties)[rows]
        order[rows] = order[rows][np.lexsort((word[order[rows]], run))]
        same = np.zeros(n, dtype=bool)
        same[1:] = word[order[1:]] == word[order[:-1]]
        ties &= same
    return order, ties


def repeated_windows(context: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance of the repeated windows of each row; -1 where there is none.

    ``context`` has LENGTH bytes on either side of the anchors, and rows with equal grams are all here.
    Equal windows have their anchors at equal places, so one distance at a time is compared, by a hash
    that moves back a byte per distance: a row costs a few numbers, whatever its windows.
    """
    n = len(context)
    low, high = np.full(n, LENGTH), np.full(n, -1)
    # Sum of value times base^i, i counting from the window's start.
    value = np.zeros(n, dtype=np.uint64)
    for i in range(LENGTH - 1, -1, -1):
        value = value * _BASE + _BYTE_VALUES[context[:, LENGTH + i]]
    power = np.uint64(pow(int(_BASE), LENGTH, 1 << 64))
    for distance in range(int(far.max(initial=-1)) + 1):
        if distance:
            value = value * _BASE + _BYTE_VALUES[context[:, LENGTH - distance]]
            value -= _BYTE_VALUES[context[:, 2 * LENGTH - distance]] * power
        rows = np.flatnonzero((near <= distance) & (distance <= far))
        rows = rows[np.argsort(value[rows], kind="stable")]
        same = value[rows[1:]] == value[rows[:-1]]
        again = np.zeros(len(rows), dtype=bool)
        again[1:] = same
        again[:-1] |= same
        again = rows[again]
        low[again] = np.minimum(low[again], distance)
        high[again] = distance
    return low, high


def _bucket_spans(table: pa.Table) -> pa.Table:
    """Removed spans around the anchors of one bucket."""
    table = table.combine_chunks()
    n = table.num_rows
    binary = pa.concat_arrays(table.column("context").chunks) if n else None
    context = np.frombuffer(binary.buffers()[2], dtype=np.uint8)[binary.offset * 2 * LENGTH :][: n * 2 * LENGTH]
    context = context.reshape(n, 2 * LENGTH)
    suffix = np.ascontiguousarray(context[:, LENGTH : LENGTH + GRAM]).view(">u8").astype(np.uint64)
    order, ties = sort_suffixes([suffix[:, i] for i in range(GRAM // 8)])
    # Only groups of several suffixes with equal leading bytes can repeat a window.
    kept = ties.copy()
    kept[:-1] |= ties[1:]
    order, starts = order[kept], np.flatnonzero(~ties[kept])
    near, far = (table.column(c).to_numpy().astype(np.int64) for c in ("near", "far"))
    at = table.column("at").to_numpy()
    low, high = np.full(n, LENGTH), np.full(n, -1)
    # Whole groups, about so many rows at a time.
    chunk = starts // _CHUNK_ROWS
    cuts = [*starts[np.flatnonzero(np.diff(chunk, prepend=-1))].tolist(), len(order)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows = order[a:b]
        low[rows], high[rows] = repeated_windows(context[rows], near[rows], far[rows])
    found = np.flatnonzero(high >= 0)
    take = pa.array(found)
    return pa.table({
        "doc_id": table.column("doc_id").take(take), "text_hash": table.column("text_hash").take(take),
        "begin": pa.array(at[found] - high[found], pa.int64()),
        "end": pa.array(at[found] - low[found] + LENGTH, pa.int64()),
    })


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, begin, end) of repeated strings, one or more spans per place."""
    spark = docs.sparkSession
    grams = docs.select("text").mapInArrow(_gram_rows, "lead bigint, h bigint")
    repeated = grams.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("lead").alias("lead")).filter("n > 1")
    repeated = stage(repeated, "repeated-grams")
    # A bitmap of fixed size tells which anchors may be repeated; others pass by chance and do no harm.
    # The bitmap functions count places from 1.
    spot = F.col("h").bitwiseAND(F.lit(BITMAP_BITS - 1)) + 1
    bits = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    maps = repeated.groupBy(F.bitmap_bucket_number(spot).alias("b"))
    for r in maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m")).toLocalIterator():
        own = np.frombuffer(r["m"], dtype=np.uint8)
        bits[(r["b"] - 1) * len(own) : r["b"] * len(own)] = own
    rows = repeated.agg(F.sum("n").alias("rows")).first()["rows"] or 0
    buckets = int(min(MOST_BUCKETS, max(1, rows // BUCKET_ROWS)))
    shares = [i / buckets for i in range(1, buckets)]
    splitters = np.zeros(0, dtype=np.int64)
    if shares and rows:
        found = repeated.agg(F.percentile_approx("lead", shares, 100_000).alias("p")).first()["p"]
        splitters = np.unique(np.array(found, dtype=np.int64))
    context = spark.sparkContext
    suffixes = docs.mapInArrow(
        partial(_suffix_rows, repeated=context.broadcast(bits), splitters=context.broadcast(splitters)),
        "bucket int, doc_id bigint, text_hash bigint, at bigint, near int, far int, context binary",
    )
    return suffixes.groupBy("bucket").applyInArrow(
        _bucket_spans, "doc_id bigint, text_hash bigint, begin bigint, end bigint"
    )


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()
        out = []
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), texts, batch.column("spans").to_pylist(), strict=True):
            digest, at, removed, runs, last = hashlib.sha256(), 0, 0, 0, -1
            for span in sorted((s["begin"], s["end"]) for s in spans or []):
                begin, end = max(span[0], at), span[1]
                if end <= begin:
                    continue
                digest.update(text[at:begin])
                runs += begin != last
                removed += end - begin
                at = last = end
            digest.update(text[at:])
            out.append((doc_id, len(text), removed, runs, digest.hexdigest()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Per document: bytes, bytes removed, runs removed, and a digest of what is kept."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    spans = stage(repeated_spans(texts), "spans")
    # As many spans as a text has anchors.
    by_text = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.collect_list(F.struct("begin", "end")).alias("spans")
    )
    same = (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    cut = texts.join(by_text, same, "left").select("doc_id", "text", "spans")
    return cut.mapInArrow(_cut_rows, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op1_suffix_array_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Remove every byte covered by a 200-byte string that also starts elsewhere."""
    return dedup_substrings(docs)
