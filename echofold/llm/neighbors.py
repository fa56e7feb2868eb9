"""Approximate nearest neighbors by an inverted multi-index.

Vectors are scaled to length 1, where the nearest by distance is the nearest by cosine, and cut into
two halves. Each half has its own ``CENTROIDS`` centroids, fitted by k-means on a bounded sample; a
vector's cell is the pair of its halves' nearest centroids. A query walks the pairs in order of the
sum of its two squared distances, with a heap that opens a pair only after both pairs before it, until
the cells visited hold ``CANDIDATES`` of all rows, and everything in them is ranked by exact cosine.

Equal vectors are one entry, with the smallest ids that any query can need, and equal queries one
query, so the copies of a vector that a third of all rows share never meet. Entries are dealt by their
first half's centroid, in slices of bounded size, and queries in blocks; a query goes to the slices
that hold its cells, and only its best few results of a slice travel on.

Vectors that are null, zero, or hold null or non-finite components take no part, neither as queries
nor as candidates; nor do rows without an id. Rows that repeat an id are separate candidates. Vectors of
another length than the most common one take no part either. Ties go to the smaller id. Other columns are ignored; an empty table gives no
rows.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.llm.tables import stage

CENTROIDS = 128
SAMPLE_ROWS = 20_000
FIT_ROUNDS = 12
# Share of all entries, and least number, that the cells visited by a query must hold.
CANDIDATES, LEAST_CANDIDATES = 0.30, 4_000
# Entries of a first-half centroid in one slice, and queries in one block.
SLICE_ROWS, BLOCK_QUERIES = 4_096, 2_048
NEAREST = 5
EVERY = 50


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with doubles of the most common length; others take no part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (common["n"] if common else 0))


def entries_of(rows: DataFrame, most: int) -> DataFrame:
    """Distinct vectors with their ``most`` smallest ids, ascending."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = rows.withColumn("place", place).filter(F.col("place") <= most)
    ids = F.array_sort(F.collect_list("vec_id")).alias("ids")
    return first.groupBy("v").agg(ids).withColumn("entry", F.element_at("ids", 1))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component first, so that no square overflows."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def k_means(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS, seed: int = 0) -> np.ndarray:
    random = np.random.default_rng(seed)
    centers = x[random.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = squared_distances(x, centers).argmin(axis=1)
        for j in range(len(centers)):
            if (home == j).any():
                centers[j] = x[home == j].mean(axis=0)
    return centers


def walk(one: np.ndarray, two: np.ndarray, held: dict[tuple[int, int], int], wanted: int) -> list[tuple[int, int]]:
    """Cells in order of summed distance until they hold ``wanted`` entries."""
    first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap = [(one[first[0]] + two[second[0]], 0, 0)]
    opened = np.zeros((len(first) + 1, len(second) + 1), dtype=bool)
    cells, found = [], 0
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        opened[i, j] = True
        cell = (int(first[i]), int(second[j]))
        if cell in held:
            cells.append(cell)
            found += held[cell]
        # A pair waits until its neighbors nearer in either half are done.
        if i + 1 < len(first) and (j == 0 or opened[i + 1, j - 1]):
            heapq.heappush(heap, (one[first[i + 1]] + two[second[j]], i + 1, j))
        if j + 1 < len(second) and (i == 0 or opened[i - 1, j + 1]):
            heapq.heappush(heap, (one[first[i]] + two[second[j + 1]], i, j + 1))
    return cells


def search(vectors: DataFrame, queries: Column, k: int = NEAREST, centroids: int = CENTROIDS) -> DataFrame:
    """The ``k`` nearest found of every row that ``queries`` selects: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors)
    # A query is not its own candidate: one more id than wanted is enough of any vector.
    entries = stage(entries_of(rows, k + 1), "entries")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], result)
    drawn = entries.orderBy(F.xxhash64("entry")).limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    sample = unit(np.stack(drawn.to_list()))
    half = sample.shape[1] // 2
    # Two small tables of centroids, whatever the number of rows.
    centers = (k_means(sample[:, :half], centroids), k_means(sample[:, half:], centroids))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = unit(np.stack(batch["v"].to_list()))
                yield batch.assign(
                    one=squared_distances(x[:, :half], centers[0]).argmin(axis=1),
                    two=squared_distances(x[:, half:], centers[1]).argmin(axis=1),
                )

    placed = entries.mapInPandas(assign, "v array<double>, ids array<bigint>, entry bigint, one int, two int")
    index = stage(placed, "multi-index")
    # At most centroids x centroids rows.
    held = {(r["one"], r["two"]): r["count"] for r in index.groupBy("one", "two").count().collect()}
    wanted = max(LEAST_CANDIDATES, int(CANDIDATES * total))
    in_one: dict[int, int] = {}
    for (a, _), n in held.items():
        in_one[a] = in_one.get(a, 0) + n
    slices = {a: -(-n // SLICE_ROWS) for a, n in in_one.items()}

    asked = stage(rows.filter(queries).groupBy("v").agg(F.min("vec_id").alias("query")), "queries")
    blocks = -(-asked.count() // BLOCK_QUERIES)
    if not blocks:
        return spark.createDataFrame([], result)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = unit(np.stack(batch["v"].to_list()))
            one, two = squared_distances(x[:, :half], centers[0]), squared_distances(x[:, half:], centers[1])
            out = []
            for n, (query, v) in enumerate(zip(batch["query"], batch["v"], strict=True)):
                by_row: dict[tuple[int, int], list[int]] = {}
                for a, b in walk(one[n], two[n], held, wanted):
                    for part in range(slices[a]):
                        by_row.setdefault((a, part), []).append(b)
                out += [(query, v, a, part, cells) for (a, part), cells in by_row.items()]
            yield pd.DataFrame(out, columns=["query", "v", "one", "part", "cells"])

    routes = asked.mapInPandas(route, "query bigint, v array<double>, one int, part int, cells array<int>")
    routes = routes.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    counts = spark.createDataFrame(list(slices.items()), "one int, parts int")
    dealt = index.join(F.broadcast(counts), "one")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int")).drop("parts")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rank(key, queries_here: pd.DataFrame, entries_here: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "vec_id", "score"]
        if not len(queries_here) or not len(entries_here):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype({"query": "int64", "vec_id": "int64"})
        x, ids = unit(np.stack(entries_here["v"].to_list())), entries_here["ids"].to_list()
        two, entry = entries_here["two"].to_numpy(), entries_here["entry"].to_numpy()
        out = []
        for query, v, cells in zip(queries_here["query"], queries_here["v"], queries_here["cells"], strict=True):
            inside = np.flatnonzero(np.isin(two, cells))
            score = x[inside] @ unit(v[None, :])[0]
            # Ties beyond the last place are kept: exact scores and ids decide later.
            order = np.lexsort((entry[inside], -score))
            last = score[order[min(k, len(order) - 1)]] - 1e-12 if len(order) else 0
            for at in order[: max(k + 1, int((score >= last).sum()))]:
                out += [(query, i, float(cosine(v, entries_here["v"].iloc[inside[at]]))) for i in ids[inside[at]]]
        return pd.DataFrame(out, columns=columns)

    deal = ["one", "part", "block"]
    found = routes.groupBy(*deal).cogroup(dealt.groupBy(*deal)).applyInPandas(
        rank, "query bigint, vec_id bigint, score double"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    # Back from distinct query vectors to the rows that ask.
    askers = rows.filter(queries).select(F.col("vec_id").alias("query_id"), "v")
    askers = askers.join(asked, "v").select("query_id", "query")
    own = askers.join(found, "query").filter("vec_id <> query_id")
    by_query = Window.partitionBy("query_id").orderBy("place")
    return own.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two original vectors in double precision."""
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    plain = np.sqrt(a @ a) * np.sqrt(b @ b)
    if np.isfinite(plain) and plain > 0:
        return float(a @ b / plain)
    return float(unit(a[None, :])[0] @ unit(b[None, :])[0])


def op7_nearest_neighbors(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """The 5 nearest found of every row whose id is divisible by 50, among all other rows."""
    return search(vectors, F.col("vec_id") % EVERY == 0)
