"""Queries of the corpus operators and the SQL that gives the same rows, by name."""

from __future__ import annotations

from . import classifier, decontaminate, html_text, line_dedup, mixing, neardup, quality_rules, substring_dedup, tokens, warc

QUERIES = {
    "op1_near_dedup": neardup.query,
    "op2_mix_sources": mixing.query,
    "op3_decontaminate": decontaminate.query,
    "op4_warc_transactions": warc.query,
    "op5_token_output": tokens.query,
    "op6_line_dedup": line_dedup.query,
    "op7_quality_rules": quality_rules.query,
    "op8_html_text": html_text.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_quality_classifier": classifier.query,
}

SQL = {
    "op2_mix_sources": mixing.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op4_warc_transactions": warc.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_quality_rules": quality_rules.SQL,
}
