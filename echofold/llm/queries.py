"""The registered queries of this package."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echofold.llm.alignment import op11_cross_tokenizer_alignment
from echofold.llm.fingerprints import op4_document_fingerprints
from echofold.llm.jaccard import op8_ngram_jaccard_join
from echofold.llm.language import op2_language_id
from echofold.llm.lines import op3_line_dedup
from echofold.llm.mixing import op10_source_mixing
from echofold.llm.neighbors import op7_nearest_neighbors
from echofold.llm.packing import op9_best_fit_packing
from echofold.llm.perspectives import op6_perspective_rotation
from echofold.llm.resampling import op12_importance_resampling
from echofold.llm.simhash import op13_simhash_near_dedup
from echofold.llm.substrings import op1_suffix_array_dedup
from echofold.llm.tables import table
from echofold.llm.token_files import op5_token_files


def _over(name: str, operator: Callable[[SparkSession, DataFrame], DataFrame]):
    return lambda spark, sf_dir: operator(spark, table(spark, sf_dir, name))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": _over("documents", op1_suffix_array_dedup),
    "op2_language_id": _over("documents", op2_language_id),
    "op3_line_dedup": _over("documents", op3_line_dedup),
    "op4_document_fingerprints": _over("documents", op4_document_fingerprints),
    "op5_token_files": _over("documents", op5_token_files),
    "op6_perspective_rotation": _over("conversations", op6_perspective_rotation),
    "op7_nearest_neighbors": _over("embeddings", op7_nearest_neighbors),
    "op8_ngram_jaccard_join": _over("documents", op8_ngram_jaccard_join),
    "op9_best_fit_packing": _over("documents", op9_best_fit_packing),
    "op10_source_mixing": _over("documents", op10_source_mixing),
    "op11_cross_tokenizer_alignment": _over("documents", op11_cross_tokenizer_alignment),
    "op12_importance_resampling": op12_importance_resampling,
    "op13_simhash_near_dedup": _over("documents", op13_simhash_near_dedup),
}
