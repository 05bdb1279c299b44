"""The queries of this subpackage, for the driver's entry module."""

from __future__ import annotations

from . import class_lm, decontamination, language_id, near_duplicates, personal_data, piece_encoding, quality_compression, quality_rules, tool_calls, toxicity


def queries() -> dict:
    return {
        "op1_tool_calls": tool_calls.query,
        "op2_quality_rules": quality_rules.query,
        "op3_toxicity": toxicity.query,
        "op4_ngram_jaccard": near_duplicates.query,
        "op5_language_id": language_id.query,
        "op6_quality_classifier": quality_compression.query,
        "op7_personal_data": personal_data.query,
        "op8_decontamination": decontamination.query,
        "op9_sentencepiece": piece_encoding.query,
        "op10_lm_scoring": class_lm.query,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others learn or hash, and the tests hold them against brute force."""
    return {"op1_tool_calls": tool_calls.ORACLE, "op4_ngram_jaccard": near_duplicates.ORACLE}
