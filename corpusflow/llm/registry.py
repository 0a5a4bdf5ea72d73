"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from corpusflow.llm import (
    benchmark_hits, bpe_codec, lm_scores, merkle_manifest, near_duplicates, quality_classifier, quality_rules, ranked_search, repeated_bytes,
    repeated_phrases, shuffle_shards, token_counts, url_rules,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op10_lm_scores": lm_scores.op10_lm_scores,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_url_filters": url_rules.op13_url_filters,
    "op2_bpe_codec": bpe_codec.op2_bpe_codec,
    "op3_sharding": shuffle_shards.op3_sharding,
    "op4_near_duplicates": near_duplicates.op4_near_duplicates,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_substring_dedup": repeated_phrases.op6_substring_dedup,
    "op7_byte_repeats": repeated_bytes.op7_byte_repeats,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_benchmark_decontamination": benchmark_hits.op9_benchmark_decontamination,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op11_ranked_search": ranked_search.ORACLE_SQL,
    "op12_merkle_manifest": merkle_manifest.ORACLE_SQL,
    "op13_url_filters": url_rules.ORACLE_SQL,
    "op4_near_duplicates": near_duplicates.ORACLE_SQL,
    "op6_substring_dedup": repeated_phrases.ORACLE_SQL,
    "op7_byte_repeats": repeated_bytes.ORACLE_SQL,
    "op9_benchmark_decontamination": benchmark_hits.ORACLE_SQL,
}
