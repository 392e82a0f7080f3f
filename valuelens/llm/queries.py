"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from valuelens.llm import q_audit, q_chat, q_decontaminate, q_language, q_lines, q_lm, q_near, q_pack, q_repeats, q_resample, q_toxicity, q_url, q_whitening

QUERIES = {
    "op1_quality_rules": q_lines.op1_quality_rules,
    "op2_best_fit_packing": q_pack.op2_best_fit_packing,
    "op3_quality_classifier": q_resample.op3_quality_classifier,
    "op4_toxicity": q_toxicity.op4_toxicity,
    "op5_ngram_jaccard_join": q_near.op5_ngram_jaccard_join,
    "op6_benchmark_decontamination": q_decontaminate.op6_benchmark_decontamination,
    "op7_lm_scoring": q_lm.op7_lm_scoring,
    "op8_language_id": q_language.op8_language_id,
    "op9_substring_dedup": q_repeats.op9_substring_dedup,
    "op10_url_filters": q_url.op10_url_filters,
    "op11_embedding_whitening": q_whitening.op11_embedding_whitening,
    "op12_chat_formatting": q_chat.op12_chat_formatting,
    "op13_filter_audit": q_audit.op13_filter_audit,
}
ORACLES = {
    "op1_quality_rules": q_lines.SQL,
    "op6_benchmark_decontamination": q_decontaminate.SQL,
    "op9_substring_dedup": q_repeats.SQL,
    "op10_url_filters": q_url.SQL,
    "op12_chat_formatting": q_chat.SQL,
    "op13_filter_audit": q_audit.SQL,
}
