"""Perspective rotation of multi-party dialogues.

For every participant of a conversation the whole dialogue is rendered once: their turns as the
assistant's, everybody else's as turns of a named user, and system turns as system messages. The
mask covers what the assistant is to learn: the text and the end mark of their own turns.

Turns are numbered by a distributed sort, and a rendering comes in chunks of ``CHUNK_TURNS`` turns,
so a conversation that holds a third of all rows is rendered by many tasks, and no task holds more
than a chunk. Chunk by chunk, the texts of a rendering concatenate to the dialogue; ``start`` tells
where in it a chunk begins, and masks count from there.

Turns are in the order of turn number, then speaker, then text, nulls first; repeated rows are
repeated turns. A null or empty speaker is the unnamed user and no participant; system is no
participant either. A null text is an empty one. A conversation without participants gives no rows,
nor does an empty table; a null conversation id is a conversation of its own. Other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.llm.tables import numbered, stage

CHUNK_TURNS = 512
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>\n"


def _named(conv: DataFrame) -> DataFrame:
    """Turns with a conversation key that also holds where the id is null."""
    return conv.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").isNull().alias("no_conv"),
        F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _head(speaker: Column, participant: Column) -> Column:
    """The line that opens a turn, as ``participant`` sees it."""
    return F.concat(
        F.lit(START),
        F.when(speaker == participant, F.lit("assistant"))
        .when(speaker == SYSTEM, F.lit(SYSTEM))
        .when(speaker == "", F.lit("user"))
        .otherwise(F.concat(F.lit("user name="), speaker)),
        F.lit("\n"),
    )


def render(conversations: DataFrame) -> DataFrame:
    """One row per conversation, participant and chunk: rendered text and masked spans.

    Columns: conv_id, participant, chunk, start, n_turns, n_own, text, masks (array of begin and end,
    in characters of the chunk).
    """
    key = ["conv", "no_conv"]
    order = [F.col(c) for c in (*key, "turn", "speaker", "text")]
    turns = numbered(_named(conversations), order, "turns")
    begins = turns.groupBy(*key).agg(F.min("row_no").alias("first"))
    turns = turns.join(begins, key).withColumn("at", F.col("row_no") - F.col("first"))
    turns = stage(turns.withColumn("chunk", F.floor(F.col("at") / CHUNK_TURNS)).drop("row_no", "first"), "chunks")
    people = turns.filter((F.col("speaker") != "") & (F.col("speaker") != SYSTEM))
    people = people.select(*key, F.col("speaker").alias("participant")).distinct()
    seen = turns.join(people, key).withColumn("head", _head(F.col("speaker"), F.col("participant")))
    own = F.col("speaker") == F.col("participant")
    size = F.length("head") + F.length("text") + len(END)
    view = [*key, "participant", "chunk"]
    # A chunk has at most CHUNK_TURNS turns: collected and laid end to end in order.
    parts = seen.groupBy(*view).agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if(own).alias("n_own"), F.sum(size).alias("size"),
        F.array_sort(F.collect_list(F.struct("at", "head", "text", own.alias("own"), size.alias("size")))).alias("turns"),
    )
    empty = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))

    def extend(acc: Column, t: Column) -> Column:
        begin = acc["end"] + F.length(t["head"])
        end = acc["end"] + t["size"]
        span = F.array(F.struct(begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end")))
        return F.struct(
            end.cast("bigint").alias("end"), F.when(t["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    rendered = parts.select(
        *view, "n_turns", "n_own", "size", text.alias("text"), F.aggregate("turns", empty, extend)["spans"].alias("masks")
    )
    # Few chunks per rendering: one row each.
    before = Window.partitionBy(*key, "participant").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0)).cast("bigint")
    conv = F.when(~F.col("no_conv"), F.col("conv")).cast(conversations.schema["conv_id"].dataType)
    return rendered.select(
        conv.alias("conv_id"), "participant", F.col("chunk").cast("bigint").alias("chunk"), start.alias("start"),
        "n_turns", "n_own", "text", "masks",
    )


def op6_perspective_rotation(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Every participant's rendering of every conversation, as digests of text and masks."""
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["begin"], m["end"])), ",")
    return render(conversations).select(
        "conv_id", "participant", "chunk", "start", "n_turns", "n_own", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), masks.alias("masks"),
    )
