"""Exact Jaccard join of 5-word shingle sets in metric space.

Jaccard distance (1 - similarity) is a metric, and documents link at a distance of 0.25 or less.
Unrelated documents are all at distance 1, where document pivots separate nothing: the window of the
triangle inequality would copy every document to every region. The first level therefore takes
one-shingle sets as pivots. All pivots inside a document are equally near to it, so a fixed order
breaks the tie, and the regions a link can cross to are exactly those of the document's first
``n - ceil(0.75 n) + 1`` pivots in that order: two sets whose first pivots are all different differ
in too many shingles to link. The order puts shingles that many documents have last, so passages
that a large part of the corpus shares do not become regions of unrelated documents.

Inside a region, documents do share content, and document pivots work. Small regions are compared pair
by pair, told by the pivots they share. In a larger one the member that lies in most regions is the pivot, and
regions of one pivot are one: the members of a family of near copies meet once, not once per passage. Every
member is compared exactly with its pivots. Members at distances from a pivot that differ by more than 0.25
cannot link, and those that are both near it are connected already; of the others some are
taken as further pivots in rounds, until all members of a region are connected or compared
(``graph.connect``). Before two sets are compared, 1,024 parity bits of each tell most that are too
different: bits that differ are shingles that only one of them has.

Sets are 64-bit hashes of shingles; equal sets are one node from the start, so copies are never
paired, and rows are never told by their ids. A null text, or one without words, has an empty set and
links with nothing; rows that repeat a ``doc_id`` are documents of their own, which may be in different
components; a null ``doc_id`` is never the smallest, and a component of only such rows has a null id; other
columns are ignored; an empty table gives no rows.
"""

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.batches import steps
from echofold.llm.graph import connect
from echofold.llm.tables import only_wanted, stage

WORDS = 5
# Similarity as whole hundredths.
PERCENT = 75
# Shingles in more regions' lists than this are put last in the order, the most frequent ones first ...
FREQUENT = 12
# ... as far as this many, which bounds what is broadcast; further ones only make larger regions.
MOST_FREQUENT = 1 << 18
# Regions of one-shingle pivots with at most so many members are compared pair by pair.
SMALL_REGION = 32
# Slots of a set's parity bits. Sets of thousands of shingles fill them at random, and then they tell nothing apart.
PARITIES = 1_024
_BITS = [f"p{i}" for i in range(PARITIES // 64)]
# Pivots of a region in the first round, and their growth: few pairs are left to compare with each.
FIRST_PIVOTS = 32
MORE_PIVOTS = 16
_STEP_BYTES = 4 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                     0x85EBCA77C2B2AE63], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, all in a row, and the borders between texts."""
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(lower)
    offsets = np.asarray(lists.offsets)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if not len(flat):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    coded = flat.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    # White space at either end of a text leaves an empty word.
    filled = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[codes]
    codes, doc = codes[filled], doc[filled]
    words = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(words)
    h = hashes[codes]
    value = np.zeros(len(h), dtype=np.uint64)
    # Position of each word from its text's end: the word starts a shingle if enough follow.
    behind = np.repeat(ends, words) - np.arange(len(h))
    size = np.minimum(np.repeat(words, words), WORDS)
    for i in range(WORDS):
        # Shorter texts stop at their end; their number of words marks them.
        inside = i < size
        at = np.minimum(np.arange(len(h)) + i, len(h) - 1)
        value += np.where(inside & (i < behind), _mixed(h[at] + _FACTORS[i]) * _FACTORS[i], np.uint64(0))
    starts = behind >= size
    value = _mixed(value + size.astype(np.uint64) * _FACTORS[0])[starts]
    doc = doc[starts]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])


def _summed(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Wrapping sums between borders."""
    ends = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values)])
    return ends[borders[1:]] - ends[borders[:-1]]


def _names(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A number that names each set, whichever row it comes from."""
    one, two = _summed(_mixed(values), borders), _summed(_mixed(values ^ _FACTORS[1]), borders)
    return _mixed(one + _mixed(two + np.diff(borders).astype(np.uint64)) * _FACTORS[2]).view(np.int64)


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and name of each document's set."""
    for batch in batches:
        for part in steps(batch, "text", _STEP_BYTES):
            values, borders = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(borders), pa.int64()),
                 pa.array(_names(values, borders))],
                names=["doc_id", "text_hash", "n_shingles", "node"],
            )


def _prefix_rows(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    """The first pivots of each document: its shingles in order, as many as a link cannot do without."""
    last = frequent.value
    for batch in batches:
        for part in steps(batch, "text", _STEP_BYTES):
            values, borders = shingle_sets(part.column("text"))
            n = np.diff(borders)
            doc = np.repeat(np.arange(len(n)), n)
            common = np.zeros(len(values), dtype=bool)
            if len(last) and len(values):
                at = np.minimum(np.searchsorted(last, values), len(last) - 1)
                common = last[at] == values
            # Values ascend inside a document already: only the common ones move behind the others.
            order = np.lexsort((common, doc)) if common.any() else np.arange(len(values))
            place = np.arange(len(values)) - borders[doc]
            first = place < (n - -(-PERCENT * n // 100) + 1)[doc]
            chosen, owner = values[order][first], doc[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen.view(np.int64)), pa.array(_names(values, borders)[owner]),
                 pa.array(n[owner], pa.int32())],
                names=["cell", "node", "info"],
            )


def parities(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """For each set, whether each of PARITIES slots gets an odd number of its shingles, as a row of 64-bit words.

    Shingles that two sets share cancel out: where the bits differ, at least one shingle is in only one of them.
    """
    n = len(borders) - 1
    slot = (values % np.uint64(PARITIES)).astype(np.int64) + np.repeat(np.arange(n), np.diff(borders)) * PARITIES
    odd = (np.bincount(slot, minlength=n * PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(n, PARITIES // 64)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text", _STEP_BYTES):
            values, borders = shingle_sets(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values.view(np.int64)))
            bits = [pa.array(np.ascontiguousarray(word)) for word in parities(values, borders).T]
            columns = [pa.array(_names(values, borders)), pa.array(np.diff(borders), pa.int32()), *bits, lists]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", *_BITS, "shingles"])


def _prefixes(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(cell, node, info) for the first pivots of every document."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    return texts.mapInArrow(partial(_prefix_rows, frequent=shared), "cell bigint, node bigint, info int")


def _frequent(texts: DataFrame) -> np.ndarray:
    """The shingles that most documents have among their first pivots: at most MOST_FREQUENT numbers."""
    plain = _prefixes(texts, np.zeros(0, dtype=np.uint64)).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    found = plain.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "cell").limit(MOST_FREQUENT)
    return np.sort(found.select("cell").toPandas()["cell"].to_numpy(dtype=np.int64).view(np.uint64))


def _cells(texts: DataFrame) -> DataFrame:
    """The cells that several nodes share, with their members."""
    rows = stage(_prefixes(texts, _frequent(texts)), "prefixes")
    several = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    # Copies of a set that came along are the same node.
    found = rows.join(several, "cell", "left_semi").groupBy("cell", "node").agg(F.first("info").alias("info"))
    found = stage(found, "prefix-cells")
    several = found.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    return stage(found.join(several, "cell", "left_semi"), "cells")


def _of_ids(texts: DataFrame, ids: DataFrame, exact: bool) -> DataFrame:
    """Rows of ``texts`` whose id, null included, is among ``ids``; others too, if ``exact`` is not asked for.

    The first sieve moves no text.
    """
    key = F.xxhash64("doc_id").alias("_key")
    wanted = stage(ids.select(key).distinct(), "wanted-ids")
    rows = only_wanted(texts.select("*", key), wanted, "_key")
    return (rows.join(wanted, "_key", "left_semi") if exact else rows).select(*texts.columns)


def row_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, and the smallest doc_id reachable by links.

    Links are between sets, so rows are told apart by their texts and never by their ids.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = texts.select("*", F.xxhash64("text").alias("text_hash"))
    rows = stage(signed.mapInArrow(_signature_rows, "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint"), "sets")
    # Equal sets are one node; empty ones stay alone.
    named = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named = stage(named, "nodes")
    # Sets are worked out again from the rows that have a set's smallest id, and from few others.
    texts = _of_ids(texts, named.select(F.col("first_id").alias("doc_id")), exact=False)

    found = _cells(texts)
    cells = stage(_distinct_cells(found), "distinct-cells")
    large = cells.filter(F.col("members") > SMALL_REGION)
    pairs = stage(_pairs_of_small_cells(cells.filter(F.col("members") <= SMALL_REGION), large), "near-pairs")
    regions = stage(_regions(large), "regions")
    candidates = [regions.select("node"), regions.select("pivot"), pairs.select("a"), pairs.select("b")]
    sets = _candidate_sets(texts, named, stage(reduce(DataFrame.union, candidates).distinct(), "candidates"))
    measure = _measure(sets)
    spokes = stage(measure(regions.select(F.col("pivot").alias("a"), F.col("node").alias("b"))), "spokes")
    links = spokes.union(measure(stage(_sieved(pairs, sets), "sieved-pairs"))).filter("linked").select("a", "b")
    members = spokes.join(sets.select(F.col("node").alias("b"), "n", *_BITS), "b")
    info = F.struct("n", "distance", *_BITS).alias("info")
    groups = connect(
        members.select(F.col("a").alias("cell"), F.col("b").alias("node"), info), _can_link, measure,
        known=links, first_pivots=FIRST_PIVOTS, more_pivots=MORE_PIVOTS,
    )
    grouped = named.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = stage(grouped.join(smallest, "component").select("node", "component", "component_id"), "labels")
    alone = F.col("n_shingles") == 0
    return rows.join(labels, "node", "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(~alone, F.col("component")).alias("component"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def join_groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles and the smallest doc_id reachable by links."""
    return row_groups(docs).select("doc_id", "n_shingles", "component_id")


def _distinct_cells(found: DataFrame) -> DataFrame:
    """One of the cells that hold the same members, as near copies share most of theirs, and how many these are."""
    members = found.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"),
    )
    one = members.groupBy("n", "sum", "xor").agg(F.min("cell").alias("cell"), F.count(F.lit(1)).alias("times"))
    return found.join(one.select("cell", "times", F.col("n").alias("members")), "cell")


def _enough(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes ``a`` and ``b`` that share so many of their first pivots can link."""
    most = shared + F.ceil(F.greatest(a, b) * PERCENT / 100) - 1
    return most >= F.ceil((a + b) * PERCENT / (100 + PERCENT))


def _pairs_of_small_cells(small: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs of the members of small cells that can link, by the number of first pivots they share.

    If two sets share c of their first pivots, whatever else they share lies behind the first pivots
    of one of them, so the sets share at most c plus the longer such rest. Pivots of large cells are
    not counted out; each is taken as shared.
    """
    unknown = large.groupBy("node").agg(F.sum("times").alias("unknown"))
    members = small.join(unknown, "node", "left").withColumn("unknown", F.coalesce("unknown", F.lit(0)))
    a = members.select("cell", "times", *[F.col(c).alias(f"a_{c}") for c in ("node", "info", "unknown")])
    b = members.select("cell", *[F.col(c).alias(f"b_{c}") for c in ("node", "info", "unknown")])
    met = a.join(b, "cell").filter((F.col("a_node") < F.col("b_node")) & _sizes_fit(F.col("a_info"), F.col("b_info")))
    counted = met.groupBy("a_node", "b_node").agg(
        F.sum("times").alias("shared"), *[F.first(c).alias(c) for c in ("a_info", "b_info", "a_unknown", "b_unknown")]
    )
    shared = F.col("shared") + F.least("a_unknown", "b_unknown")
    return counted.filter(_enough(shared, F.col("a_info"), F.col("b_info"))).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def _sizes_fit(a: Column, b: Column) -> Column:
    """A link needs the smaller set to have 75% of the larger one's size."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _regions(large: DataFrame) -> DataFrame:
    """(pivot, node): the members of all cells that have the same pivot.

    A cell's pivot is its member that lies in most cells, as the text that the others were made from does, so the
    many cells of a family of near copies become one region. Two members of a cell are in its pivot's region.
    """
    degree = large.groupBy("node").agg(F.sum("times").alias("degree"))
    first = F.max(F.struct("degree", F.xxhash64("node").alias("hash"), "node"))["node"].alias("pivot")
    pivots = large.select("cell", "node").join(degree, "node").groupBy("cell").agg(first)
    return large.select("cell", "node").join(pivots, "cell").filter("node != pivot").select("pivot", "node").distinct()


def _candidate_sets(texts: DataFrame, named: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, parity bits, shingles) of the nodes in ``wanted``, worked out once."""
    ids = named.join(wanted, "node", "left_semi").select(F.col("first_id").alias("doc_id"))
    bits = ", ".join(f"{p} bigint" for p in _BITS)
    sets = _of_ids(texts, ids, exact=True).mapInArrow(_set_rows, f"node bigint, n int, {bits}, shingles array<bigint>")
    return stage(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "shingles")


def _parities_fit(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether two sets' parities leave room for a link: it allows (1 - J) / (1 + J) of both sizes to be in one only."""
    apart = reduce(Column.__add__, [F.bit_count(a(p).bitwiseXOR(b(p))) for p in _BITS])
    return apart * (100 + PERCENT) <= (a("n") + b("n")) * (100 - PERCENT)


def _can_link(a: Column, b: Column) -> Column:
    """Whether two members of a region can link, by their distances from its pivot, sizes and parities."""
    near = F.abs(a["distance"] - b["distance"]) <= 1 - PERCENT / 100 + 1e-9
    return near & _sizes_fit(a["n"], b["n"]) & _parities_fit(a.getField, b.getField)


def _sieved(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose parities leave room for a link."""
    a, b = (sets.select(*[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", *_BITS)]) for side in "ab")
    met = pairs.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
    return met.filter(_parities_fit(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).select("a", "b")


def _measure(sets: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Exact distances of pairs of candidates."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))

    def measure(pairs: DataFrame) -> DataFrame:
        compared = pairs.join(a, "a").join(b, "b").select(
            "a", "b", F.size(F.array_intersect("a_set", "b_set")).alias("both"),
            (F.size("a_set") + F.size("b_set")).alias("sizes"),
        )
        whole = F.col("sizes") - F.col("both")
        linked = F.col("both") * 100 >= whole * PERCENT
        return compared.select("a", "b", (1 - F.col("both") / whole).alias("distance"), linked.alias("linked"))

    return measure


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of each group of linked ones: that with the smallest id, null last, then text hash.

    A row is told by its id and text, so other texts under the id of one that goes stay. Rows that agree in
    both are one document: one of them stays. Rows without words are never linked and all stay.
    """
    rows = stage(row_groups(docs).filter("component is not null"), "grouped-rows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    firsts = rows.groupBy("component").agg(F.min(place).alias("first"))
    gone = rows.join(firsts, "component").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash")
    repeated = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    keyed = docs.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))

    def of(keys: DataFrame, kind: str, rows: DataFrame) -> DataFrame:
        own = keys.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
        same = rows["doc_id"].cast("bigint").eqNullSafe(F.col("_gone_id")) & (F.col("_text_hash") == F.col("_gone_hash"))
        return rows.join(own, same, kind)

    kept = of(stage(gone.distinct(), "rows-to-drop"), "left_anti", keyed)
    repeated = stage(repeated, "repeated-rows")
    if not repeated.isEmpty():
        again = of(repeated, "left_semi", kept).dropDuplicates(["doc_id", "_text_hash"])
        kept = of(repeated, "left_anti", kept).unionByName(again)
    return kept.select(*docs.columns)


def op8_ngram_jaccard_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Groups of documents linked at a Jaccard similarity of 0.75 or more."""
    return join_groups(docs)
