"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, language_id, license_scan, mixing, ngram_join, quality_model, quality_rules, topk_search, url_filters


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_mixing": mixing.op3_mixing,
        "op4_bpe": bpe.op4_bpe,
        "op5_quality_model": quality_model.op5_quality_model,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_topk_search": topk_search.op7_topk_search,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_language_id": language_id.op9_language_id,
        "op10_url_filters": url_filters.op10_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op2_license_scan": license_scan.ORACLE,
        "op3_mixing": mixing.ORACLE,
        "op6_ngram_join": ngram_join.ORACLE,
        "op7_topk_search": topk_search.ORACLE,
        "op8_chat_format": chat_format.ORACLE,
        "op10_url_filters": url_filters.ORACLE,
    }
