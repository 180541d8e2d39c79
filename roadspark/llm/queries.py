"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadspark.llm import (
    hard_negatives,
    line_blocks,
    mixing,
    near_dedup,
    ngram_ratio,
    packing,
    pairwise_quality,
    prefix_trie,
    pu_toxicity,
    sharding,
    token_blocks,
    toolcalls,
    winnowing,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing": winnowing.op1_winnowing,
    "op2_tool_calls": toolcalls.op2_tool_calls,
    "op3_ngram_ratio": ngram_ratio.op3_ngram_ratio,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_pu_toxicity": pu_toxicity.op5_pu_toxicity,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_pairwise_quality": pairwise_quality.op7_pairwise_quality,
    "op8_token_blocks": token_blocks.op8_token_blocks,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_line_blocks": line_blocks.op10_line_blocks,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_minimax_shards": sharding.op12_minimax_shards,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op2_tool_calls": toolcalls.OP2_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_minimax_shards": sharding.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
