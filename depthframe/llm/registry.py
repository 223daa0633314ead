"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from depthframe.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    filter_audit,
    language_id,
    license_scan,
    packing,
    secret_links,
    set_join,
    substring_dedup,
    token_counts,
    toxicity,
    vector_codes,
)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_jaccard_join": set_join.op4_jaccard_join,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_preference_format": chat_format.op8_preference_format,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_secret_links": secret_links.op13_secret_links,
}

SQL = {
    "op4_jaccard_join": set_join.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op8_preference_format": chat_format.SQL,
    "op9_license_scan": license_scan.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
