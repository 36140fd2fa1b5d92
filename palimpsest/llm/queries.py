"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, language_kernel, mixing, periodic_runs, quality_qda, quality_rules, sharding, simhash, token_alignment, token_ids, toxicity, warc

QUERIES = {
    "op1_pareto_mix": mixing.op1_pareto_mix,
    "op2_quality_qda": quality_qda.op2_quality_qda,
    "op3_simhash_components": simhash.op3_simhash_components,
    "op4_warc_derivatives": warc.op4_warc_derivatives,
    "op5_minimax_shards": sharding.op5_minimax_shards,
    "op6_chat_windows": chat_format.op6_chat_windows,
    "op7_parquet_token_ids": token_ids.op7_parquet_token_ids,
    "op8_weak_toxicity": toxicity.op8_weak_toxicity,
    "op9_adaptive_rules": quality_rules.op9_adaptive_rules,
    "op10_spaced_seed_overlaps": decontaminate.op10_spaced_seed_overlaps,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_language_kernel": language_kernel.op13_language_kernel,
}

ORACLES = {
    "op1_pareto_mix": mixing.ORACLE,
    "op6_chat_windows": chat_format.ORACLE,
}
