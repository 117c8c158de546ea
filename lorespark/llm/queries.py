"""Queries of this folder and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, imatch, langid, licenses, mixing, ngram_join, packing, quality, suffix_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_language_id": langid.op6_language_id,
    "op7_imatch": imatch.op7_imatch,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_packing": packing.op9_packing,
    "op10_license_scan": licenses.op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
}
