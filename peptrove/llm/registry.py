"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, extraction, jaccard, licenses, lm, media, packing, secret_scan, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bidirectional_gru": toxicity.op1_bidirectional_gru,
    "op2_aho_corasick": decontamination.op2_aho_corasick,
    "op3_random_forest": secret_scan.op3_random_forest,
    "op4_context_tree_weighting": lm.op4_context_tree_weighting,
    "op5_rare_token_index": licenses.op5_rare_token_index,
    "op6_sampled_splitters": sharding.op6_sampled_splitters,
    "op7_sum_of_squares": packing.op7_sum_of_squares,
    "op8_linear_chain": extraction.op8_linear_chain,
    "op9_local_descriptors": media.op9_local_descriptors,
    "op10_minhash_forest": jaccard.op10_minhash_forest,
}

ORACLE_SQL: dict[str, str] = {"op2_aho_corasick": decontamination.OP2_SQL}
