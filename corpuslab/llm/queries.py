"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from corpuslab.llm import alignment, chat, decontaminate, filter_audit, html_text, jaccard, language_model, licenses, packing, pii, quality, substrings, token_counts

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.query,
    "op2_decontamination": decontaminate.query,
    "op3_html_text": html_text.query,
    "op4_chat_perspectives": chat.query,
    "op5_license_scan": licenses.query,
    "op6_best_fit_packing": packing.query,
    "op7_personal_data": pii.query,
    "op8_quality_rules": quality.query,
    "op9_language_model": language_model.query,
    "op10_substring_dedup": substrings.query,
    "op11_token_alignment": alignment.query,
    "op12_filter_audit": filter_audit.query,
    "op13_token_counts": token_counts.query,
}
ORACLES = {
    "op2_decontamination": decontaminate.ORACLE,
    "op4_chat_perspectives": chat.ORACLE,
    "op5_license_scan": licenses.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op10_substring_dedup": substrings.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
