"""The training-data pipeline: quality classifier, exact dedup, near-duplicate join, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the
columns of documents.

Rows: nulls, empty and very long texts, ties and repeated rows are treated as the operators' modules say (a null
text is an empty one; of equal rows one stays; an empty text is kept if the classifier passes it, and mixing then
leaves it out as it has no words); empty tables give empty results, and without labels nothing passes the
classifier; columns other than those of documents are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import exact_dedup, mixing, ngram_join, packing, quality
from lorespark.llm.common import documents, drop, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the quality classifier accepts; it learns from the labels of the documents at hand."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).filter("predicted = 1").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.kept_rows(spark, docs).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document."""
    return ngram_join.representatives(spark, docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows' ids in sequences of 2048."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet and read again."""
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            drop(docs)  # of the stage before, which nothing reads any more
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL: str | None = None
