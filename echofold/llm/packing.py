"""Pattern packing: fit repeat counts of few-document patterns to the length histogram.

The histogram of piece lengths has at most ``capacity`` entries, whatever the table's size. Patterns
are the sets of one to three lengths that fill a sequence exactly. Non-negative least squares fits how
often each is repeated so that together they use up the histogram; counts are rounded down and then
up again, largest remainder first, while the pieces last. What is left is packed by best fit on the
histogram, longest first. The result is a list of rules: pieces number ``first`` to ``first + count``
of one length go to consecutive sequences at one offset. Pieces get their number within their length
from a distributed sort, so a length that a third of all pieces share is no hot key.

Null texts are empty and give a piece that holds the end id alone; repeated rows and ties in
``doc_id`` are packed each on its own; an empty table gives no rows; other columns are ignored.
"""

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import tokens
from echofold.llm.batches import steps
from echofold.llm.tables import numbered, stage
from echofold.llm.token_files import checksum

CAPACITY = 2_048
# Steps of the accelerated projected gradient.
FIT_STEPS = 150
# Weight of the lengths that fill gaps easily in the fit's residual.
SHORT_WEIGHT = 0.09
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
])
_WITH_IDS = _ARROW.append(pa.field("ids", pa.list_(pa.int32())))


def cut_rows(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    """Encode documents and cut those above ``capacity``; the first piece takes the remainder."""
    encoder = tokens.encoder(path, True)
    for batch in batches:
        for part in steps(batch, "text", tokens.STEP_BYTES):
            ids, counts = encoder.encode(part.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = counts - capacity * (pieces - 1)
            length = np.where(number == 0, head[doc], capacity)
            start = np.where(number == 0, 0, head[doc] + (number - 1) * capacity)
            ends = np.cumsum(length)
            sums = [checksum(ids[e - n : e]) for e, n in zip(ends, length, strict=True)]
            columns = [
                part.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(sums, pa.int64()),
            ]
            if with_ids:
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.view("<i4"))))
            yield pa.RecordBatch.from_arrays(columns, schema=_WITH_IDS if with_ids else _ARROW)


def pieces_of(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    cut = partial(cut_rows, path=tokenizer, end_id=end_id, capacity=capacity, with_ids=with_ids)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema)


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All sets of at most three of the lengths present that add up to the capacity; 0 pads a row."""
    here = np.zeros(capacity + 1, dtype=bool)
    here[present] = True
    rows = [np.array([[capacity, 0, 0]])] if here[capacity] else []
    low = present[(present <= capacity // 2)]
    pairs = low[here[capacity - low]]
    rows.append(np.stack([capacity - pairs, pairs, np.zeros_like(pairs)], axis=1))
    small = present[present <= capacity // 3]
    for c in small.tolist():
        b = present[(present >= c) & (present <= (capacity - c) // 2)]
        b = b[here[capacity - c - b]]
        rows.append(np.stack([capacity - c - b, b, np.full_like(b, c)], axis=1))
    return np.concatenate(rows)


def fit(table: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative repeat counts that bring the patterns' use of each length nearest to the histogram."""
    capacity = len(histogram) - 1
    weight = np.ones(capacity + 1)
    weight[: capacity // 8] = SHORT_WEIGHT
    weight[0] = 0
    cells = table.T

    def use(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(c, weights=x, minlength=capacity + 1) for c in cells)

    def pull(r: np.ndarray) -> np.ndarray:
        return sum(r[c] for c in cells)

    # Preconditioned by how many patterns compete for a pattern's lengths.
    crowd = np.maximum(use(np.ones(len(table))), 1)
    step = 1 / np.maximum(pull(weight * crowd), 1e-9)
    x = y = pull(np.where(weight > 0, histogram / crowd, 0)) / 3
    t = 1.0
    for _ in range(steps):
        moved = np.maximum(y - step * pull(weight * (use(y) - histogram)), 0)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = np.maximum(moved + (t - 1) / t_next * (moved - x), 0)
        x, t = moved, t_next
    return x


def round_counts(table: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeat counts that the histogram can serve, and what they leave of it."""
    left = histogram.copy()
    counts = np.zeros(len(table), dtype=np.int64)
    rows = table.tolist()

    def take(i: int, most: int) -> None:
        need: dict[int, int] = {}
        for length in rows[i]:
            if length:
                need[length] = need.get(length, 0) + 1
        most = min(most, *(int(left[n]) // k for n, k in need.items()))
        if most > 0:
            counts[i] += most
            for n, k in need.items():
                left[n] -= k * most

    whole = np.floor(x + 1e-9).astype(np.int64)
    for i in np.flatnonzero(whole).tolist():
        take(i, int(whole[i]))
    for i in np.argsort(-(x - whole), kind="stable").tolist():
        take(i, 1)
    return counts, left


def plan(histogram: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, first, count, sequence, offset, per_sequence) that place every piece.

    Piece number ``first + i`` of a length goes to sequence ``sequence + i // per_sequence``, at
    ``offset + (i % per_sequence) * length``.
    """
    capacity = len(histogram) - 1
    present = np.flatnonzero(histogram)
    rules: list[tuple[int, int, int, int, int, int]] = []
    used = np.zeros(capacity + 1, dtype=np.int64)
    sequences = 0

    def place(length: int, count: int, sequence: int, offset: int, per: int) -> None:
        rules.append((length, int(used[length]), count, sequence, offset, per))
        used[length] += count

    left = histogram.astype(np.int64)
    table = patterns(present, capacity) if len(present) else np.zeros((0, 3), dtype=np.int64)
    if len(table):
        counts, left = round_counts(table, fit(table, histogram.astype(float)), left)
        for i in np.flatnonzero(counts).tolist():
            offset = 0
            for length in table[i].tolist():
                if length:
                    place(length, int(counts[i]), sequences, offset, 1)
                    offset += length
            sequences += int(counts[i])

    # Best fit on what is left: runs of sequences with equal room, by room.
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}

    def give(room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in runs:
                insort(rooms, room)
                runs[room] = []
            heapq.heappush(runs[room], (sequence, count))

    for length in range(capacity, 0, -1):
        need = int(left[length])
        while need:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                sequence, have, room = sequences, -(-need // (capacity // length)), capacity
                sequences += have
            else:
                room = rooms[at]
                sequence, have = heapq.heappop(runs[room])
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            per = room // length
            full = min(have, need // per)
            if full:
                place(length, full * per, sequence, capacity - room, per)
                give(room - per * length, sequence, full)
                need -= full * per
            if full < have and need:
                place(length, need, sequence + full, capacity - room, need)
                give(room - need * length, sequence + full, 1)
                full, need = full + 1, 0
            give(room, sequence + full, have - full)
    return rules


def place_rows(
    batches: Iterator[pa.RecordBatch], firsts: np.ndarray, rules: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Look up each piece's rule by (length, number within the length)."""
    for batch in batches:
        length = batch.column("length").to_numpy()
        number = batch.column("number").to_numpy()
        key = length * _SPAN + number
        rule = rules[np.searchsorted(firsts, key, side="right") - 1]
        i, per = number - rule[:, 1], rule[:, 5]
        sequence = rule[:, 3] + i // per
        offset = rule[:, 4] + (i % per) * length
        columns = [batch.column(n) for n in _ARROW.names] + [pa.array(sequence), pa.array(offset)]
        schema = _ARROW.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


# More pieces of one length than any table has.
_SPAN = 1 << 50


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece a sequence and its place in it."""
    spark = pieces.sparkSession
    # Written first: the range borders are drawn from the rows, and the texts are encoded once.
    rows = stage(pieces.select(*_ARROW.names), "cut-pieces")
    order = [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("start")]
    in_order = numbered(rows, order, "pieces")
    # One row per length: bounded by the capacity.
    found = in_order.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first")).collect()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in found:
        histogram[r["length"]] = r["n"]
    # The number of rules depends on the capacity alone: three per pattern and a few per length.
    rules = np.array(plan(histogram) or [(0,) * 6], dtype=np.int64)
    keys = rules[:, 0] * _SPAN + rules[:, 1]
    by_key = np.argsort(keys)
    begins = spark.createDataFrame([(r["length"], r["first"]) for r in found], "length bigint, first bigint")
    numbers = in_order.join(F.broadcast(begins), "length").withColumn("number", F.col("row_no") - F.col("first"))
    place = partial(place_rows, firsts=keys[by_key], rules=rules[by_key])
    return numbers.mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")


def sequences_of(placed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """The sequences themselves: ids in order and the borders of their pieces."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = pieces_with_ids.dropDuplicates(keys)
    held = placed.join(ids, [placed[k].eqNullSafe(ids[k]) for k in keys]).select(
        placed["sequence_id"], placed["offset"], placed["doc_id"], placed["length"], ids["ids"]
    )
    # A sequence holds at most ``capacity`` ids.
    grouped = held.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("parts")
    )
    return grouped.select(
        "sequence_id",
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.transform("parts", lambda p: p["offset"]).alias("offsets"),
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
    )


def op9_best_fit_packing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pack all documents, end id 0, into sequences of at most 2,048 tokens."""
    import public_tokenizers

    return pack(pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))
