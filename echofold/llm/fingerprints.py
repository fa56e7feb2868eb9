"""Document fingerprints by consistent weighted sampling.

A document's terms are its lower-cased words, weighted by how often they occur. For each of
``SAMPLES`` numbers k, every term draws two gamma variables and a uniform one from its hash and k, as
improved consistent weighted sampling does: with r, c ~ Gamma(2, 1) and b ~ U(0, 1),
t = floor(ln(weight) / r + b) and ln a = ln c - r (t - b) - r. The term with the smallest a, with its
t, is sample k. Two documents have the same sample with a probability that is the generalised Jaccard
similarity of their weights, the sum of the smaller weights over the sum of the larger ones; the
share of equal samples estimates it.

Documents are dealt once, by ranges of ``doc_id`` in descending order, and everything up to the
finished fingerprints happens inside a range: the next document's text, the terms' counts and the
smallest draws need no further exchange. Ranges are drawn from quantiles of the ids. Ids that many
rows share fall into one range; rows that tie in ``doc_id`` follow each other by text.

A null text is an empty one; texts without words have an empty fingerprint's value, the same for
all, and equal each other. A null ``doc_id`` comes last. The one document of a table is its own next one. Other
columns are ignored; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.llm.tables import SPACE, stage

SAMPLES = 64
# Samples worked out per generated row: few enough for one compiled method.
_PER_ROW = 8
# Rows of a range, about.
RANGE_ROWS = 1_024
MOST_RANGES = 1 << 12
# Rows of a range that share a term's draws, at most.
LISTED = 1_024
# A draw packs ln a in fixed point above the bits that name the sample; a fingerprint keeps the name.
_SCALE, _NAME_BITS = 1 << 36, 16
_BYTES = _NAME_BITS // 8


def _borders(docs: DataFrame) -> list[int]:
    """Lower borders of the ranges: bounded in number, from the ids alone."""
    rows = docs.count()
    parts = int(min(MOST_RANGES, max(1, rows // RANGE_ROWS)))
    if parts == 1:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 100_000).alias("p")).first()["p"]
    return sorted(set(found or []))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with the text of the next one in descending order of ids; the last has the first's.

    Adds ``range`` and ``place``, which name a row, and ``next_range`` and ``next_place``.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    # Null ids come last: they have the highest range, the largest ids the lowest.
    ranges = F.coalesce(-_bisect(_borders(rows)), F.lit(1)).cast("int")
    dealt = rows.withColumn("range", ranges)
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    placed = dealt.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    # The first row of each range is the next one of the range before: one short list of rows.
    ends = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("top"))
    ends = stage(ends, "ranges")
    tops = dealt.join(F.broadcast(ends), "range").filter(F.col("doc_id").eqNullSafe(F.col("top")))
    tops = tops.groupBy("range", "rows").agg(F.min("text").alias("top_text"))
    along = Window.orderBy("range")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = tops.select(
        "range", "rows",
        F.coalesce(F.lead("range").over(along), F.first("range").over(whole)).alias("follow"),
        F.coalesce(F.lead("top_text").over(along), F.first("top_text").over(whole)).alias("follow_text"),
    )
    last = F.col("place") == F.col("rows")
    return placed.join(F.broadcast(stage(follow, "range-ends")), "range").select(
        "doc_id", "text", "range", "place", F.coalesce("next_text", "follow_text").alias("next_text"),
        F.when(last, F.col("follow")).otherwise(F.col("range")).alias("next_range"),
        F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
    )


def _bisect(borders: list[int]) -> Column:
    """How many of the sorted borders are at or below ``doc_id``, as nested choices of logarithmic depth."""

    def between(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"if(doc_id < {borders[middle]}, {between(low, middle)}, {between(middle + 1, high)})"

    return F.when(F.col("doc_id").isNotNull(), F.expr(between(0, len(borders))))


def edited(text: str = "text", other: str = "next_text") -> Column:
    """The text with its last third replaced by the first code points of the next document."""
    third = f"int(floor(length({text}) / 3))"
    return F.expr(f"concat(substring({text}, 1, length({text}) - {third}), substring({other}, 1, {third}))")


def _uniform(bits: Column) -> Column:
    """A number in (0, 1) from 31 bits."""
    return (bits.bitwiseAND(F.lit(0x7FFFFFFF)) + F.lit(0.5)) * F.lit(1.0 / (1 << 31))


def _draw(k: Column) -> Column:
    """ln a and the sample's name for term ``h`` with ``log_weight``, packed so that the least a is the least number."""
    one, two, three = (F.xxhash64("h", k * 3 + i) for i in range(3))
    r = -F.log(_uniform(one) * _uniform(F.shiftrightunsigned(one, 32)))
    c = -F.log(_uniform(two) * _uniform(F.shiftrightunsigned(two, 32)))
    b = _uniform(three)
    t = F.floor(F.col("log_weight") / r + b)
    ln_a = F.log(c) - r * (t - b) - r
    # Draws lie far inside these bounds; 2,000 x 2^36 fits into the 48 bits above the name.
    scaled = F.least(F.greatest(ln_a, F.lit(-1000.0)), F.lit(1000.0)) * float(_SCALE)
    name = F.xxhash64("h", t, k).bitwiseAND(F.lit((1 << _NAME_BITS) - 1))
    return F.shiftleft(scaled.cast("bigint"), _NAME_BITS).bitwiseOR(name)


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprints (binary) of ``text`` and ``edited`` per row of ``texts`` (keys, text, edited) with a word in either.

    Terms that weigh the same in both texts, or in several rows, draw once for all. The last key is a number that
    neighbors share most of. No exchange is needed if the rows are dealt by one of the others.
    """
    both = texts.select(*keys, F.posexplode(F.array("text", "edited")).alias("edit", "text"))
    words = both.select(*keys, "edit", F.explode(F.split(F.lower("text"), SPACE)).alias("word")).filter("word <> ''")
    terms = words.select(*keys, "edit", F.xxhash64("word").alias("h")).groupBy(*keys, "h").agg(
        F.sum(1 - F.col("edit")).alias("w0"), F.sum("edit").alias("w1")
    )
    weighed = terms.select(*keys, "h", "w0", "w1", F.explode(F.array_distinct(F.array("w0", "w1"))).alias("w")).filter("w > 0")
    # A term's draws are the same wherever it weighs as much: they are worked out once for the rows of a list,
    # which are near each other, and then given to each. Two bits tell which of a row's texts weigh so.
    *outer, row = keys
    held = F.col(row).cast("bigint") * 4 + (F.col("w") == F.col("w0")).cast("int") * 2 + (F.col("w") == F.col("w1")).cast("int")
    shared = weighed.groupBy(*outer, "h", "w", F.floor(F.col(row) / LISTED).alias("list")).agg(F.collect_list(held).alias("held"))
    rows = shared.select(
        *outer, "h", F.log(F.col("w").cast("double")).alias("log_weight"), "held",
        F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // _PER_ROW - 1))).alias("g"),
    )
    drawn = rows.select(*outer, "g", "held", *[_draw(F.col("g") * _PER_ROW + i).alias(f"d{i}") for i in range(_PER_ROW)])
    given = drawn.select(*outer, "g", F.explode("held").alias("held"), *[f"d{i}" for i in range(_PER_ROW)])
    given = given.select(
        *outer, F.shiftright("held", 2).alias(row), "g", F.col("held").bitwiseAND(F.lit(3).cast("bigint")).alias("texts"),
        *[f"d{i}" for i in range(_PER_ROW)],
    )
    # Terms of both texts and of either one have least draws of their own first, so each draw is compared once.
    least = given.groupBy(*keys, "g", "texts").agg(*[F.min(f"d{i}").alias(f"d{i}") for i in range(_PER_ROW)])
    weighs = [F.col("texts").bitwiseAND(F.lit(2 >> e).cast("bigint")) != 0 for e in range(2)]
    least = least.groupBy(*keys, "g").agg(
        *[F.min(F.when(weighs[e], F.col(f"d{i}"))).alias(f"d{e}{i}") for e in range(2) for i in range(_PER_ROW)]
    )
    mask = F.lit((1 << _NAME_BITS) - 1)

    def whole(e: int) -> Column:
        names = F.concat(*[F.lpad(F.hex(F.col(f"d{e}{i}").bitwiseAND(mask)), 2 * _BYTES, "0") for i in range(_PER_ROW)])
        listed = F.array_sort(F.collect_list(F.when(names.isNotNull(), F.struct("g", names.alias("n")))))
        # A text without words has no draws.
        joined = F.array_join(F.transform(listed, lambda x: x["n"]), "")
        return F.when(F.size(listed) > 0, F.unhex(joined))

    return least.groupBy(*keys).agg(whole(0).alias("fingerprint"), whole(1).alias("edited_fingerprint"))


def likeness(a: str, b: str) -> Column:
    """The share of equal samples of two fingerprints."""
    return F.expr(
        f"size(filter(sequence(0, {SAMPLES - 1}), i -> "
        f"substring({a}, i * {_BYTES} + 1, {_BYTES}) = substring({b}, i * {_BYTES} + 1, {_BYTES}))) / {SAMPLES}D"
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how near these and neighbors are."""
    pairs = with_next(docs).withColumn("edited", edited())
    row = ["range", "place"]
    facts = pairs.select(
        *row, "doc_id", "next_range", "next_place", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
    )
    found = fingerprints(pairs.select(*row, "text", "edited"), row)
    # Texts without words are alike.
    empty = F.lit(bytes(SAMPLES * _BYTES))
    rows = facts.join(found, row, "left").select(
        *facts.columns, F.coalesce("fingerprint", empty).alias("fingerprint"),
        F.coalesce("edited_fingerprint", empty).alias("edited_fingerprint"),
    )
    rows = stage(rows, "fingerprints")
    following = rows.select(
        F.col("range").alias("next_range"), F.col("place").alias("next_place"), F.col("fingerprint").alias("following")
    )
    return rows.join(following, ["next_range", "next_place"]).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "following").alias("near_next"),
    )


def op4_document_fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(docs)
