"""The whole preparation over all documents, held against rules by hand in tests/test_prepare.py; SQL can't express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import Corpus, training_rows
from ..sources.prepare import prepare_corpus
from . import sql as S
from .corpus_queries import LICENCE


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with an id as a raw record; the name of its source is the title, as the table has none."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id IS NOT NULL")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("source_name"), F.col("source").alias("page_title"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("source_url"), F.expr(LICENCE).alias("licence"),
        F.lit("2024-01-01").alias("retrieved_at"), F.sha2(text, 256).alias("content_hash"), text.alias("text"),
    )


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[Corpus, DataFrame]:
    return prepare_corpus(_records(spark, sf_dir))


def prepared_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table, n: rows of each prepared table, of each kind of exclusion, and of broken rules."""
    corpus, left_out = _prepared(spark, sf_dir)
    kinds = left_out.groupBy(F.col("category").alias("table")).agg(F.count(F.lit(1)).alias("n"))
    broken = corpus.violations().agg(F.count(F.lit(1)).alias("n")).select(F.lit("violations").alias("table"), "n")
    return corpus.counts().unionByName(kinds).unionByName(broken)


def training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the training text holds of each document."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = training_rows(d.select(F.col("doc_id").alias("source_id"), F.expr(LICENCE).alias("licence"), F.col("text").alias("cleaned_text")))
    return rows.select("source_id", F.length("training_text").cast("long").alias("n_chars"), F.sha2("training_text", 256).alias("text_hash"))


QUERIES = {f.__name__: f for f in (prepared_corpus, training_texts)}

ORACLE_SQL = {
    "training_texts": rf"""WITH d AS (SELECT doc_id, text, {LICENCE} AS licence FROM documents), p AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).*?{S.WORD}') AS p FROM d WHERE licence IN ('CC-BY-4.0', 'CC-BY-SA-4.0', 'OGL-AU', 'PUBLIC-DOMAIN')),
t AS (SELECT doc_id, regexp_replace(CASE WHEN len(p) > 6000 THEN array_to_string(p[1:6000], '') ELSE text END, '^\s+|\s+$', '', 'g') AS t FROM p) SELECT doc_id AS source_id, length(t)::BIGINT AS n_chars, sha256(t) AS text_hash FROM t WHERE t <> ''""",
}
