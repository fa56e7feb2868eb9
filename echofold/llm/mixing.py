"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Weights cycle over the sources in code point order, null last. Shares of the whole mix stop at a
multiple of their source's size; what a capped source cannot take is shared again by weight until no
source is above its cap. The mix is a number of equal blocks of words. Sainte-Laguë apportionment
turns the targets into whole block quotas per source, and a source's quota into quotas per shard;
inside a shard, documents lie in seeded order, its words are cut into blocks, and a quota takes every
block a whole number of times and a seeded choice of blocks once more.

Only (source, size) rows travel; shards are hash buckets of a source, so a source that holds a third
of all rows is dealt out like any other. No block is ever a row: which blocks of a shard are chosen
follows from a seeded step through the block numbers that hits exactly the wanted count.

A null text has size 0 and takes 0 words. Rows that repeat a ``doc_id`` are mixed each on its own,
in an order fixed by their sizes. An empty table gives no rows; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.llm.tables import WORD, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 32
# A source is dealt into shards of about so many words, at most so many of them.
SHARD_WORDS = 8_192
MOST_SHARDS = 4_096
# Steps through the block numbers; primes, so that at most one of them divides a block count below 2^31.
_STEPS = (2_147_483_647, 2_147_483_629)


def sizes(docs: DataFrame) -> DataFrame:
    """One row per document: its id, source, number of words and a hash of its text."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    source = F.col("source").cast("string").alias("source")
    return docs.select("doc_id", source, words.alias("size"), F.xxhash64("text").alias("text_hash"))


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """The target of each source of ``totals`` (source, source_size).

    Sharing again by weight means one common rate: a source gets weight times rate, or its cap where
    that is less. A round caps the sources above it and works out the rate for the others; each round
    is one aggregate over the sources, and rounds end when no further source is capped.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stage(
        totals.select(
            "source", "source_size", F.element_at(cycle, (rank % len(weights) + 1).cast("int")).alias("weight")
        ),
        "mix-sources",
    )
    cap = F.col("source_size") * float(most)
    whole = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    rate, before = None, -1
    while True:
        capped = F.lit(False) if rate is None else F.col("weight") * rate > cap
        found = ranked.agg(
            F.count_if(capped).alias("capped"),
            F.sum(F.when(capped, cap)).alias("given"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weights"),
        ).first()
        if found["capped"] == before or not found["weights"]:
            break
        before = found["capped"]
        rate = (whole * share - (found["given"] or 0.0)) / found["weights"]
    if rate is None:
        return ranked.withColumn("target", F.lit(0.0))
    # With every source capped (a share equal to the cap) the last rate still gives the caps.
    return ranked.withColumn("target", F.least(F.col("weight") * rate, cap))


def apportion(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, most: str | None) -> DataFrame:
    """Sainte-Laguë: whole numbers of ``seats`` of a group for its parties, by highest quotients.

    ``votes`` over 1, 3, 5, ... are a party's quotients, and the highest ones win, as many as there
    are seats. Rounding at two divisors, one a little too large and one a little too small, encloses
    each party's result, so only the quotients between are ranked: at most two per party. Ties go to
    the party that is first in order. ``most`` bounds a party's seats.
    """
    over = Window.partitionBy(*group)
    counted = parties.withColumn("_votes", F.sum(votes).over(over)).withColumn("_parties", F.count(F.lit(1)).over(over))

    def rounded(seats_at: Column, up: bool) -> Column:
        quota = F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes") * seats_at).otherwise(0.0)
        whole = F.floor(quota + 0.5 + (1e-9 if up else -1e-9))
        return F.greatest(whole, F.lit(0)).cast("bigint")

    half = F.col("_parties") / 2
    lower = rounded(F.greatest(F.col(seats) - half, F.lit(0.0)), up=False)
    upper = rounded(F.col(seats) + half, up=True) + 1
    enclosed = counted.withColumn("_lower", lower).withColumn("_upper", upper)
    if most:
        enclosed = enclosed.withColumn("_lower", F.least("_lower", most)).withColumn("_upper", F.least("_upper", most))
    enclosed = enclosed.withColumn("_left", F.col(seats) - F.sum("_lower").over(over))
    slots = F.when(F.col("_upper") > F.col("_lower"), F.sequence(F.col("_lower"), F.col("_upper") - 1))
    quotients = enclosed.select(*group, party, votes, "_left", F.explode(slots).alias("_seat"))
    quotients = quotients.withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") + 1))
    order = Window.partitionBy(*group).orderBy(F.desc("_quotient"), F.col(party).asc_nulls_last())
    won = quotients.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= F.col("_left"))
    keys = [F.col(c).alias(f"_key_{c}") for c in [*group, party]]
    won = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in [*group, party]]
    return enclosed.join(won, same, "left").select(
        *parties.columns,
        (F.col("_lower") + F.coalesce(F.col("_won"), F.lit(0))).alias("quota"),
    )


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS, seed: int = 0,
) -> DataFrame:
    """Per document: size, its source's size and target, and the words of it that the mix takes.

    ``every`` is how often the whole document is taken; ``at``, ``n_blocks``, ``step``, ``begin`` and
    ``extra`` tell which of its blocks are taken once more.
    """
    rows = stage(sizes(docs), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = stage(
        targets(totals, weights, share, most).withColumn("all", F.lit(0))
        .withColumn("block_seats", F.lit(0).cast("bigint")), "mix-targets",
    ).drop("block_seats")
    wanted = aims.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    blocks = aims.withColumn("block_seats", F.lit(round(wanted / block_words)).cast("bigint"))
    by_source = apportion(blocks, ["all"], "source", "target", "block_seats", None).select(
        F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("no_source"),
        "source_size", "target", F.col("quota").alias("source_quota"),
        F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(1), F.floor(F.col("source_size") / SHARD_WORDS)))
        .alias("n_shards"),
    )
    by_source = stage(by_source, "mix-quotas")

    draw = F.xxhash64(F.col("doc_id"), F.lit(seed))
    keyed = rows.withColumn("source_key", F.coalesce("source", F.lit(""))).withColumn(
        "no_source", F.col("source").isNull()
    )
    source = ["source_key", "no_source"]
    dealt = keyed.join(by_source, source).withColumn("draw", draw).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("shard")), F.col("n_shards"))
    )
    shard = [*source, "shard"]
    shards = dealt.groupBy(*shard).agg(
        F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota")
    )
    shards = shards.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words)))
    shards = shards.withColumn("most_blocks", F.col("n_blocks") * most)
    quotas = apportion(shards, source, "shard", "shard_size", "source_quota", "most_blocks").select(
        *shard, "n_blocks", "quota"
    )
    laid = Window.partitionBy(*shard).orderBy("draw", "doc_id", "size")
    before = laid.rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    n_blocks = F.col("n_blocks")
    step = F.when(n_blocks % _STEPS[0] == 0, F.lit(_STEPS[1])).otherwise(F.lit(_STEPS[0])) % n_blocks
    begin = F.pmod(F.xxhash64("source_key", "shard", F.lit(seed)), n_blocks)
    placed = placed.join(quotas, shard).select(
        "doc_id", F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "text_hash", "size",
        "source_size", "target", "at", "n_blocks", step.alias("step"), begin.alias("begin"),
        F.floor(F.col("quota") / n_blocks).alias("every"), (F.col("quota") % n_blocks).alias("extra"),
    )
    return placed.withColumn("taken", _taken(block_words))


def _chosen(block: Column, prefix: str = "") -> Column:
    """Whether a block of the shard is taken once more: its number, stepped through all, is below the rest."""
    step, begin, n_blocks, extra = (F.col(prefix + c) for c in ("step", "begin", "n_blocks", "extra"))
    return (block * step + begin) % n_blocks < extra


def _taken(block_words: int) -> Column:
    """Words taken of a document that covers ``at`` to ``at + size`` of its shard."""
    end = F.col("at") + F.col("size")

    def words(block: Column) -> Column:
        inside = F.least((block + 1) * block_words, end) - F.greatest(block * block_words, F.col("at"))
        return F.when(_chosen(block), inside).otherwise(F.lit(0))

    first = F.floor(F.col("at") / block_words)
    last = F.floor((end - 1) / block_words)
    once_more = F.aggregate(F.sequence(first, last), F.lit(0).cast("bigint"), lambda a, b: a + words(b))
    return F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("size") * F.col("every") + once_more).cast("bigint")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: whole documents as often as they are taken whole, and
    a row with the words of the blocks taken once more. Words keep the white space behind them, and
    ``n_chars`` follows the text.
    """
    plan = mix(docs, block_words=block_words, **options).filter("taken > 0")
    # Under names of their own, so that no column of the input is taken for one of the plan.
    plan = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns if c not in ("source_size", "target", "taken")])
    texts = docs.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "text"])
    same = (
        (F.col("_hash") == F.col("_mix_text_hash")) & F.col("doc_id").eqNullSafe(F.col("_mix_doc_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("_mix_source"))
    )
    words = F.regexp_extract_all("text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), 1)
    part = F.array_join(
        F.filter(words, lambda w, i: _chosen(F.floor((F.col("_mix_at") + i) / block_words), "_mix_")), ""
    )
    whole = F.when(F.col("_mix_every") > 0, F.array_repeat("text", F.col("_mix_every").cast("int"))).otherwise(F.array())
    rows = texts.join(plan, same).withColumn("text", F.explode(F.concat(whole, F.array(part))))
    rows = rows.filter("text <> ''")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def op10_source_mixing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Mix all documents: 150% of all words, weights 5, 2, 1 repeating, no source above twice its size."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
