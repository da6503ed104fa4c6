"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import chat, html, mixing, packing, quality, secrets, simhash, substring, suffix, topk

QUERIES = {
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_quality_rules": quality.op3_quality_rules,
    "op1_packing": packing.op1_packing,
    "op4_suffix_array_dedup": suffix.op4_suffix_array_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_html_extraction": html.op7_html_extraction,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_exact_top_k": topk.op9_exact_top_k,
    "op10_substring_dedup": substring.op10_substring_dedup,
}

ORACLE_SQL = {
    "op2_chat_formatting": chat.SQL,
    "op3_quality_rules": quality.SQL,
    "op5_mixing": mixing.SQL,
    "op6_secret_scans": secrets.SQL,
    "op9_exact_top_k": topk.SQL,
}
