"""Near-duplicates by SimHash, found with a hierarchical index over Gray-ordered fingerprints.

Fingerprints of all documents are reduced to distinct ones and sorted by their Gray rank, so that
neighbors in the order share most of their bits. Blocks of neighbors are the leaves of an index. A
node's pattern is what all fingerprints beneath it share: a mask of their common bits, and the values of
these. Two nodes whose patterns differ in more bits than a link may have are pruned with all beneath
them; the others are replaced by the pairs of their children, whose masks repeat the parents' bits and
add more, so the differences accumulate on the way down. Levels are tables, and going down one level is
a join of node pairs with their children; pairs of blocks that are left are compared in tasks, by the
same kind of tree over the block's own fingerprints.

Links have at most three differing bits, so at most one of them lies in one of a fingerprint's halves.
The index is therefore built twice, with either half leading, and allows one difference in the leading
half and three in all: few blocks are left for each other, and every link is found in one of the two.

Blocks hold distinct fingerprints and equal numbers of them, so however many documents are copies, no
block is larger than the others. A pair of blocks returns links enough to connect what it links, fewer
than it has fingerprints, and skips groups that are connected already; connected groups are then found
over all links (``graph.components``).

A null text, and one without words, has fingerprint zero and is linked like any other. Rows that repeat
a ``doc_id`` are documents of their own; a null ``doc_id`` is never the smallest, and a component of only
such rows has a null id. An empty table gives no rows; other columns are ignored.
"""

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.graph import components
from echofold.llm.tables import numbered, stage

SHINGLE_WORDS = 3
HASH_SEED = 42
MOST_BITS = 3
# Bits of the leading half that may differ in the order that finds a link.
LEADING_BITS = MOST_BITS // 2
# Fingerprints of a block, of a leaf inside it, and children of a node between blocks and the root.
BLOCK = 4_096
LEAF = 32
CHILDREN = 16
# Texts are cut into words this many bytes at a time.
SLICE_BYTES = 1 << 20
# Leaf pairs compared in one step.
STEP_LEAVES = 256

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANKS = frozenset(b" \t\n\x0b\x0c\r")
_xxh64 = partial(xxhash.xxh64_intdigest, seed=HASH_SEED)


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice; no word is cut."""
    start = 0
    while start < len(text):
        end = start + SLICE_BYTES
        while end < len(text) and text[end] not in _BLANKS:
            end += 1
        yield text[start:end].translate(_LOWER).split()
        start = end


def _bit_counts(shingles: Iterable[bytes]) -> tuple[np.ndarray, int]:
    hashes = np.fromiter(map(_xxh64, shingles), dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64), len(hashes)


def fingerprint(text: bytes) -> int:
    """The majority of every bit over the hashes of a text's shingles, repeats included."""
    ones, n, kept = np.zeros(64, dtype=np.int64), 0, []
    for words in _word_runs(text):
        words = kept + words
        triples = zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)
        found, more = _bit_counts(map(b" ".join, triples))
        ones, n = ones + found, n + more
        kept = words[1 - SHINGLE_WORDS :]
    if not n and kept:
        ones, n = _bit_counts([b" ".join(kept)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(text.as_py() or b"") for text in batch.column("text")], dtype=np.uint64)
        yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "code"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Columns doc_id and ``code``, the 64 bits of the fingerprint."""
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(_fingerprint_batches, "doc_id bigint, code bigint")


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order, as a number that sorts like the unsigned place."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def half_turned(code: Column) -> Column:
    """The code with its halves exchanged."""
    return F.shiftleft(code, 32).bitwiseOR(F.shiftrightunsigned(code, 32))


def blocks(codes: DataFrame, name: str) -> DataFrame:
    """Blocks of neighbors in Gray order: node, its parent, ``all_ones`` and ``any_ones``, and the codes."""
    ordered = numbered(codes, [gray_rank(F.col("code"))], name, "place")
    block = F.col("place").cast("bigint")
    found = ordered.groupBy(F.floor(block / BLOCK).alias("node")).agg(
        F.bit_and("code").alias("all_ones"), F.bit_or("code").alias("any_ones"), F.collect_list("code").alias("codes")
    )
    return stage(found, f"{name}-blocks")


def _parents(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.floor(F.col("node") / CHILDREN).alias("node")).agg(
        F.bit_and("all_ones").alias("all_ones"), F.bit_or("any_ones").alias("any_ones")
    )


def _near(most: int, leading: int) -> Column:
    """Whether the patterns of the nodes a and b leave room for a link between them.

    Bits that differ are those that all of one side have and none of the other has.
    """
    apart = "(a_all & ~b_any) | (b_all & ~a_any)"
    return F.expr(f"bit_count({apart}) <= {most} and bit_count(shiftrightunsigned({apart}, 32)) <= {leading}")


def near_blocks(leaves: DataFrame, most: int = MOST_BITS, leading: int = LEADING_BITS) -> DataFrame:
    """Pairs of blocks (a <= b) that may hold a link, by going down the index from its root."""
    levels = [leaves.select("node", "all_ones", "any_ones")]
    n_nodes = leaves.count()
    while n_nodes > CHILDREN:
        levels.append(stage(_parents(levels[-1]), "gray-level"))
        n_nodes = -(-n_nodes // CHILDREN)
    # The top level has at most CHILDREN nodes, which are the root's children.
    spark = leaves.sparkSession
    pairs = spark.createDataFrame([(0, 0)], "a bigint, b bigint")
    for level in reversed(levels):
        parent = F.floor(F.col("node") / CHILDREN)
        sides = [
            level.select(
                parent.alias(f"{s}_parent"), F.col("node").alias(f"{s}_node"),
                F.col("all_ones").alias(f"{s}_all"), F.col("any_ones").alias(f"{s}_any"),
            )
            for s in "ab"
        ]
        below = pairs.withColumnsRenamed({"a": "a_parent", "b": "b_parent"})
        below = below.join(sides[0], "a_parent").join(sides[1], "b_parent").filter("a_node <= b_node")
        below = below.filter(_near(most, leading))
        pairs = stage(below.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "gray-pairs")
    return pairs


def _leaf_patterns(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(codes), LEAF)
    return np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)


def _near_leaves(a: np.ndarray, b: np.ndarray, most: int, leading: int) -> np.ndarray:
    """Pairs of leaves of two blocks that may hold a link."""
    (a_all, a_any), (b_all, b_any) = _leaf_patterns(a), _leaf_patterns(b)
    apart = (a_all[:, None] & ~b_any[None, :]) | (b_all[None, :] & ~a_any[:, None])
    near = (np.bitwise_count(apart) <= most) & (np.bitwise_count(apart >> np.uint64(32)) <= leading)
    return np.argwhere(near)


class _Groups:
    """Connected groups of numbered members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """Connect pairs of members; yields the places of pairs that connect two groups."""
        apart = np.flatnonzero(self.label[a] != self.label[b])
        _, first = np.unique(
            self.label[a][apart] * np.int64(len(self.label)) + self.label[b][apart], return_index=True
        )
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        for at in apart[first].tolist():
            x, y = find(int(self.label[a[at]])), find(int(self.label[b[at]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                yield at
        if root:
            changed = np.arange(len(self.label))
            changed[list(root)] = [find(x) for x in root]
            self.label = changed[self.label]


def links_between(a: np.ndarray, b: np.ndarray, same: bool, most: int, leading: int) -> np.ndarray:
    """Links (code, code) that connect whatever two blocks link, as an array of pairs.

    Pairs of leaves are taken step by step; one whose members are all in one group already has
    nothing to add.
    """
    groups = _Groups(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    pairs = _near_leaves(a, b, most, leading)
    if same:
        pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
    # Leaves close in order first: they hold most links.
    pairs = pairs[np.argsort(np.abs(pairs[:, 0] - pairs[:, 1]), kind="stable")]
    every = np.arange(LEAF)
    found = []
    for start in range(0, len(pairs), STEP_LEAVES):
        step = pairs[start : start + STEP_LEAVES]
        # Members beyond the last one repeat it.
        left = np.minimum(step[:, :1] * LEAF + every, len(a) - 1)
        right = np.minimum(step[:, 1:] * LEAF + every, len(b) - 1)
        left_label, right_label = groups.label[left], groups.label[right + shift]
        one = (left_label == left_label[:, :1]).all(axis=1) & (right_label == left_label[:, :1]).all(axis=1)
        left, right = left[~one], right[~one]
        differ = a[left][:, :, None] ^ b[right][:, None, :]
        near = np.bitwise_count(differ) <= most
        k, i, j = np.nonzero(near)
        x, y = left[k, i], right[k, j]
        for at in groups.join(x, y + shift):
            found.append((a[x[at]], b[y[at]]))
    return np.array(found, dtype=np.uint64).reshape(-1, 2)


def _compare(batches: Iterable[pa.RecordBatch], turned: bool, most: int, leading: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, left, right in zip(*(batch.column(c) for c in ("a", "b", "left", "right")), strict=True):
            sides = [s.values.to_numpy().view(np.uint64) for s in (left, right)]
            found = links_between(*sides, a.as_py() == b.as_py(), most, leading)
            if turned:
                found = (found << np.uint64(32)) | (found >> np.uint64(32))
            columns = [pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in (0, 1)]
            yield pa.record_batch(columns, names=["a", "b"])


def gray_index_links(codes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Links (a, b) that connect all distinct codes with at most ``most`` differing bits."""
    leading, found = most // 2, []
    for turned in (False, True):
        name = "gray-turned" if turned else "gray"
        order = codes.select((half_turned(F.col("code")) if turned else F.col("code")).alias("code"))
        leaves = blocks(order, name)
        pairs = near_blocks(leaves, most, leading)
        left = leaves.select(F.col("node").alias("a"), F.col("codes").alias("left"))
        right = leaves.select(F.col("node").alias("b"), F.col("codes").alias("right"))
        # Dealt by both blocks, so that one with many near blocks is compared in many tasks.
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").repartition("a", "b")
        compare = partial(_compare, turned=turned, most=most, leading=leading)
        found.append(both.mapInArrow(compare, "a bigint, b bigint"))
    return stage(found[0].unionAll(found[1]), "gray-links")


def near_duplicates(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Every document's fingerprint (16 hex digits) and component: the smallest id reachable by links."""
    coded = stage(fingerprints(docs), "simhash")
    codes = stage(coded.groupBy("code").agg(F.min("doc_id").alias("first_id")), "simhash-codes")
    groups = components(gray_index_links(codes.select("code"), most))
    placed = codes.join(groups.withColumnRenamed("node", "code"), "code", "left")
    placed = placed.withColumn("component", F.coalesce("component", "code"))
    first = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_code = stage(placed.join(first, "component").select("code", "component_id"), "simhash-groups")
    digits = F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint")
    return coded.join(by_code, "code").select("doc_id", digits, "component_id")


def op13_simhash_near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
