"""Registry of the training-data queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparktrail.llm import archives, bytepair, langid, near, packing, pagetext, rangejoin, resample, shards, substring, topk, toxicity, trie

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_sum_of_squares_packing": packing.op1_sum_of_squares_packing,
    "op2_size_tiered_shards": shards.op2_size_tiered_shards,
    "op3_compression_language": langid.op3_compression_language,
    "op10_compression_toxicity": toxicity.op10_compression_toxicity,
    "op4_crf_main_text": pagetext.op4_crf_main_text,
    "op5_fast_similarity_sketching": near.op5_fast_similarity_sketching,
    "op6_no_random_access_top_k": topk.op6_no_random_access_top_k,
    "op7_byte_level_bpe": bytepair.op7_byte_level_bpe,
    "op8_metric_range_join": rangejoin.op8_metric_range_join,
    "op9_level_wise_doubling": substring.op9_level_wise_doubling,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_conversation_prefix_trie": trie.op12_conversation_prefix_trie,
    "op13_arc_to_warc": archives.op13_arc_to_warc,
}
ORACLES: dict[str, str] = {"op2_size_tiered_shards": shards.OP2_SQL, "op11_importance_resampling": resample.OP11_SQL, "op12_conversation_prefix_trie": trie.OP12_SQL, "op13_arc_to_warc": archives.OP13_SQL}
