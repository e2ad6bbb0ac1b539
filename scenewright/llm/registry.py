"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scenewright.llm import (
    collocations,
    cotraining,
    fill_middle,
    hmm,
    line_dedup,
    media,
    merkle,
    mixing,
    packing,
    sharding,
    simhash,
    suffix_dedup,
    token_store,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining": cotraining.op1_cotraining,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_media_columns": media.op3_media_columns,
    "op4_merkle": merkle.op4_merkle,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_token_store": token_store.op7_token_store,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_hidden_markov": hmm.op10_hidden_markov,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_hash_ring": sharding.op12_hash_ring,
    "op13_collocations": collocations.op13_collocations,
}

SQL: dict[str, str] = {
    "op4_merkle": merkle.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op11_fill_in_middle": fill_middle.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
