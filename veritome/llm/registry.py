"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritome.llm import bpe, exact_dedup, html_extract, language_id, lexical_search, merkle, mixing, pii, quality_knn, quality_rules, secret_scan, simhash, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_simhash_dedup": simhash.op2_simhash_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_html_extract": html_extract.op4_html_extract,
        "op5_bpe_encode": bpe.op5_bpe_encode,
        "op6_pii": pii.op6_pii,
        "op7_quality_classifier": quality_knn.op7_quality_classifier,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_language_id": language_id.op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_mix_sources": mixing.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op10_url_filter": url_filter.ORACLE, "op11_lexical_search": lexical_search.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
