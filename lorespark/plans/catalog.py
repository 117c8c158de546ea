"""Query name -> callable, and query name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import artifact_queries, corpus_queries, extract_queries, prepare_queries, retrieval_queries, structured_queries, text_queries

MODULES = (text_queries, corpus_queries, extract_queries, prepare_queries, retrieval_queries, structured_queries, artifact_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
