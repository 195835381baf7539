"""Queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

from tidemark.llm import decontaminate, line_dedup, quality_crf, quality_rules, sentencepiece_tokens, simhash, substring, token_blocks, toxicity, url_filter

QUERIES = {
    "op1_rans_token_blocks": token_blocks.query,
    "op2_url_filter": url_filter.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_substring_dedup": substring.query,
    "op5_sentencepiece": sentencepiece_tokens.query,
    "op6_decontaminate": decontaminate.query,
    "op7_quality_rules": quality_rules.query,
    "op8_quality_classifier": quality_crf.query,
    "op9_toxicity": toxicity.query,
    "op10_line_dedup": line_dedup.query,
}
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_filter.SQL,
    "op4_substring_dedup": substring.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op10_line_dedup": line_dedup.SQL,
}
