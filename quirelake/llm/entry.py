"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe_coding, embedding_duplicates, language_id, language_model, license_scans, near_duplicates, quality_rules, repeated_passages, source_mixing, url_filters


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_license_scans": license_scans.op2_license_scans,
        "op3_url_filters": url_filters.op3_url_filters,
        "op4_bpe_coding": bpe_coding.op4_bpe_coding,
        "op5_source_mixing": source_mixing.op5_source_mixing,
        "op6_embedding_duplicates": embedding_duplicates.op6_embedding_duplicates,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_repeated_passages": repeated_passages.op8_repeated_passages,
        "op9_language_model": language_model.op9_language_model,
        "op10_near_duplicates": near_duplicates.op10_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scans": license_scans.sql(),
        "op6_embedding_duplicates": embedding_duplicates.SQL,
        "op7_quality_rules": quality_rules.SQL,
        "op8_repeated_passages": repeated_passages.SQL,
        "op10_near_duplicates": near_duplicates.SQL,
    }
