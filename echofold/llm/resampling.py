"""Resampling documents towards a target distribution, with bit-sliced sums of hashed features.

A document's features are its runs of one and two words, each counted in one of 10,000 buckets. The
buckets of all documents and those of the target texts give every bucket a gain, a whole number. A
document's weight is the floored mean of the gains of its features, and seeded Gumbel noise on the
weights turns "the highest" into a sample without replacement.

Counts are kept as bit planes: plane k of a document holds, for every bucket, bit k of its count. The
gains are planes as well, in two's complement, so the plane of the sign counts negatively. The sum of
count times gain over all buckets is then the sum over pairs of planes of a power of two times the
number of bits that both planes have set: AND and popcount on machine words, and exact. Planes are
staged once; the corpus counts and the weights are both worked out from them.

A null text and a text without words have no features and weight 0, and too few words to be drawn. A
null ``doc_id`` is the empty text in the noise and sorts first among ties; rows that repeat a
``doc_id`` are documents of their own, with the same noise; rows that tie in both score and id are
drawn in any order. An empty table of documents gives no rows, and an empty target table leaves every
``t`` at 0. Other columns are ignored.
"""

import math
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.tables import numbered, stage, table

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
# Texts are cut into words this many bytes at a time.
SLICE_BYTES = 1 << 20
# Planes that meet the gains in one step.
STEP_PLANES = 2_048

# Bytes that separate words become blanks; A-Z become a-z; bytes above ASCII are parts of words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_PLANE_WORDS = -(-BUCKETS // 64)
_PLANE_BYTES = 8 * _PLANE_WORDS

PLANES = "doc_id bigint, n_words bigint, n_features bigint, planes binary"


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice; no word is cut."""
    start = 0
    while start < len(text):
        end = start + SLICE_BYTES
        if end < len(text):
            # Up to a separator: a word that reaches across the border belongs to this slice.
            while end < len(text) and _WORDS[text[end]] != 32:
                end += 1
        yield text[start:end].translate(_WORDS).split()
        start = end


def bucket_counts(text: bytes) -> tuple[int, np.ndarray]:
    """The number of words, and how often each bucket is hit by runs of one and two words."""
    n_words, counts, last = 0, np.zeros(BUCKETS, dtype=np.int64), None
    for words in _word_runs(text):
        if not words:
            continue
        ones = list(map(crc32, words))
        # The checksum of "a b" goes on from that of "a".
        twos = map(crc32, map(b" ".__add__, words[1:]), ones)
        border = [] if last is None else [crc32(b" " + words[0], last)]
        hashes = np.fromiter(chain(ones, border, twos), dtype=np.int64)
        counts += np.bincount(hashes % BUCKETS, minlength=BUCKETS)
        n_words += len(words)
        last = ones[-1]
    return n_words, counts


def to_planes(values: np.ndarray, n_planes: int) -> np.ndarray:
    """Bit planes of whole numbers (two's complement), as rows of 64-bit words."""
    bits = (values[None, :] >> np.arange(n_planes)[:, None]) & 1
    packed = np.zeros((n_planes, _PLANE_BYTES), dtype=np.uint8)
    packed[:, : -(-BUCKETS // 8)] = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
    return packed.view(np.uint64)


def _doc_planes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            n_words, counts = bucket_counts(text.as_py() or b"")
            planes = to_planes(counts, int(counts.max()).bit_length())
            rows.append((n_words, max(0, 2 * n_words - 1), planes.tobytes()))
        words, features, planes = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(planes, pa.binary())],
            names=["doc_id", "n_words", "n_features", "planes"],
        )


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a batch's planes: the planes, the row of each, and the power of two that it stands for."""
    column = batch.column("planes")
    counts = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // _PLANE_BYTES
    ends = np.cumsum(counts)
    cuts = [0, *(np.flatnonzero(np.diff(ends // STEP_PLANES)) + 1).tolist(), len(counts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = counts[a:b]
        if not own.sum():
            continue
        data = b"".join(column.slice(a, b - a).to_pylist())
        rows = np.repeat(np.arange(a, b), own)
        powers = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        yield np.frombuffer(data, dtype=np.uint64).reshape(-1, _PLANE_WORDS), rows, powers


def _sum_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by bucket, once."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for planes, _, powers in _steps(batch):
            for power in np.unique(powers):
                bits = np.unpackbits(planes[powers == power].view(np.uint8), axis=1, count=BUCKETS, bitorder="little")
                total += bits.sum(axis=0, dtype=np.int64) << power
    hit = np.flatnonzero(total)
    yield pa.record_batch([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])


def corpus_counts(planes: DataFrame) -> np.ndarray:
    """Features of all documents by bucket: never more than the 10,000 numbers."""
    sums = planes.select("planes").mapInArrow(_sum_buckets, "bucket bigint, n bigint")
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for row in sums.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's smoothed share in the target over that in the source."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    found = [
        math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all)))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ]
    return np.array(found, dtype=np.int64)


def bit_sliced_sums(planes: np.ndarray, gain_planes: np.ndarray) -> np.ndarray:
    """For each plane, the sum of the gains of the buckets that it holds; the last gain plane is the sign's."""
    total = np.zeros(len(planes), dtype=np.int64)
    for power, gain in enumerate(gain_planes):
        common = np.bitwise_count(planes & gain).sum(axis=1, dtype=np.int64) << power
        total += -common if power == len(gain_planes) - 1 else common
    return total


def _weigh(batches: Iterable[pa.RecordBatch], gain_planes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = np.zeros(batch.num_rows, dtype=np.int64)
        for planes, rows, powers in _steps(batch):
            np.add.at(sums, rows, bit_sliced_sums(planes, gain_planes) << powers)
        features = batch.column("n_features").to_numpy()
        weight = sums // np.maximum(features, 1)
        kept = [batch.column(c) for c in ("doc_id", "n_words", "n_features")]
        yield pa.record_batch([*kept, pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Weight, score and rank of every document: doc_id, n_features, weight, score, rank.

    ``percent`` of the documents with enough words are drawn and ranked from 1; the rest have no rank.
    """

    def staged_planes(texts: DataFrame, doc_id, name: str) -> DataFrame:
        read = texts.select(doc_id.cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        return stage(read.mapInArrow(_doc_planes, PLANES), name)

    planes = staged_planes(docs, F.col("doc_id"), "resample-planes")
    wanted = staged_planes(target, F.lit(None), "resample-target")
    gain = gains(corpus_counts(planes), corpus_counts(wanted))
    n_planes = int(np.abs(gain).max()).bit_length() + 1
    weigh = partial(_weigh, gain_planes=to_planes(gain, n_planes))
    weighed = planes.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")

    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(seeded, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise).cast("bigint").alias("score"),
        (F.col("n_words") >= LEAST_WORDS).alias("eligible"),
        # Keeps rows apart that are equal in all else, so that none makes a range of its own.
        F.monotonically_increasing_id().alias("tie"),
    )
    scored = stage(scored, "resample-scored")
    drawn = scored.filter("eligible").count() * percent // 100
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("tie")]
    placed = numbered(scored, order, "resample-order")
    rank = F.when(F.col("eligible") & (F.col("row_no") < drawn), F.col("row_no") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("bigint").alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents resampled towards the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
