"""Queries over indexes, signatures and question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import retrieval as R
from ..sources import artifacts as A
from . import retrieval_queries as Q


def content_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.content_signature(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 64)


def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.index_metadata(R.bm25_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))


def query_set_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as a question set whose gold is a document of the same number."""
    b, d = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "documents"))
    gold = F.when(F.col("item_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("item_id") * 9).cast("string")))
    queries = b.select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"), F.when(F.col("item_id") % 6 != 0, "lexical").alias("query_type"), gold.alias("expected_relevant_passage_ids"), F.array(F.when(F.col("item_id") % 7 == 0, "x").otherwise("src1")).alias("expected_entity_ids"),
        (F.col("item_id") % 2 == 0).alias("expected_answerable"), F.lit("easy").alias("difficulty"), F.lit("development").alias("evaluation_split"),
    )
    return A.query_violations(queries, d.select(F.col("doc_id").cast("string").alias("passage_id")), d.select(F.col("source").alias("entity_id")).distinct())


def combined_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"))
    none = q.select("query_id", F.lit(0).cast("long").alias("id")).filter("false")
    runs = {"bm25": Q._ranked(spark, sf_dir), "hashed": Q._hashed(spark, sf_dir, 10)}
    out = A.combined_traces({name: E.traces(r, none, q) for name, r in runs.items()})
    return out.select(F.col("query_id").alias("item_id"), F.array_join("bm25", ",").alias("bm25"), F.array_join("hashed", ",").alias("hashed"))


QUERIES = {f.__name__: f for f in (content_signature, index_metadata, query_set_violations, combined_traces)}

ROW = "sha256(coalesce(doc_id::VARCHAR, '') || chr(9) || coalesce(text, ''))"
ORACLE_SQL = {
    "content_signature": f"SELECT sha256('64' || chr(10) || coalesce(string_agg(d, '' ORDER BY r), '')) AS signature FROM (SELECT substr(h, 1, 2) AS r, sha256(string_agg(h, '' ORDER BY h)) AS d FROM (SELECT {ROW} AS h FROM documents) GROUP BY 1)",
    "index_metadata": f"WITH t AS (SELECT doc_id, {Q.TOK} AS t FROM documents), p AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM t) SELECT (SELECT count(*) FROM t) AS documents, (SELECT min(len(t)) FROM t) AS least_tokens, (SELECT max(len(t)) FROM t) AS most_tokens, (SELECT count(*) FROM p) AS postings, (SELECT count(DISTINCT term) FROM p) AS terms",
    "query_set_violations": """SELECT 'missing field' AS rule, item_id::VARCHAR AS id FROM benchmark WHERE item_id % 6 = 0 UNION ALL SELECT 'unknown passage', item_id::VARCHAR FROM benchmark WHERE item_id % 5 <> 0 AND item_id * 9 NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'unknown entity', item_id::VARCHAR FROM benchmark WHERE item_id % 7 = 0 UNION ALL SELECT 'answerable without gold', item_id::VARCHAR FROM benchmark WHERE item_id % 10 = 0 UNION ALL SELECT 'number of questions', count(*)::VARCHAR FROM benchmark HAVING count(*) NOT BETWEEN 50 AND 75""",
    "combined_traces": f"WITH {Q.BM25}, {Q.HASHED} SELECT item_id, coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FROM bmr WHERE bmr.item_id = b.item_id AND rank <= 5), '') AS bm25, coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FROM hsr WHERE hsr.item_id = b.item_id AND rank <= 5), '') AS hashed FROM benchmark b",
}
