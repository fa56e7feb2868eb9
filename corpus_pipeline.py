"""A corpus from raw documents: languages, lines, near copies, mix, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from echofold.llm.jaccard import keep_one_of_each_group
from echofold.llm.language import keep_known_languages
from echofold.llm.lines import keep_first_lines
from echofold.llm.mixing import mixed_documents
from echofold.llm.packing import op9_best_fit_packing
from echofold.llm.tables import stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the others go."""
    return keep_known_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line once."""
    return keep_first_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each_group(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, repeats as further rows."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens and their places in sequences."""
    return op9_best_fit_packing(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# Language models and tokenizers have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    *earlier, (_, last) = STAGES
    for name, apply in earlier:
        docs = stage(apply(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
