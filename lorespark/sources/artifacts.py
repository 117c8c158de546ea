"""Stored indexes, signatures, question sets, tokenizers and run logs.

Null ids and texts enter signatures as empty text and are violations in question sets.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lm import SPECIAL
from ..operators.quality import duplicate_ids, failing, orphans, violations
from ..operators.retrieval import SparseIndex

QUERY = "query_id string, question string, query_type string, expected_relevant_passage_ids array<string>, expected_entity_ids array<string>, expected_answerable boolean, difficulty string, annotation_notes string, evaluation_split string"


def save_index(index: SparseIndex, path: str) -> None:
    """Postings sorted by term within files, so that asked terms prune row groups; lengths and terms beside them."""
    index.postings.repartition("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")


def load_index(spark: SparkSession, path: str) -> SparseIndex:
    return SparseIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms")))


def content_signature(passages: DataFrame, id_: str, text: str, dimension: int) -> DataFrame:
    """signature: changes with any id, text or the dimension.

    Rows are hashed, the hashes of each of 256 ranges are hashed in order, and those once more: no task sees
    more than a range's digests. Encodings are reused only under an equal signature.
    """
    row = F.sha2(F.concat_ws("\t", F.coalesce(F.col(id_).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))), 256)
    rows = passages.select(row.alias("h")).withColumn("r", F.substring("h", 1, 2))
    ranges = rows.groupBy("r").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "d"))), lambda x: x["d"]), "")
    return ranges.agg(F.sha2(F.concat(F.lit(f"{dimension}\n"), whole), 256).alias("signature"))


def index_metadata(index: SparseIndex) -> DataFrame:
    """One row: documents, shortest and longest in tokens, postings, distinct terms."""
    size = index.lengths.agg(F.count(F.lit(1)).alias("documents"), F.min("len").alias("least_tokens"), F.max("len").alias("most_tokens"))
    posted = index.postings.agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("term").alias("terms"))
    return size.join(F.broadcast(posted))  # one row


def query_violations(queries: DataFrame, passages: DataFrame, entities: DataFrame, least: int = 50, most: int = 75) -> DataFrame:
    """rule, id of what is wrong with a question set: ids, missing fields, unknown gold, answerable without gold, its size."""
    fields = [c for c in ("query_id", "question", "query_type", "expected_answerable", "difficulty", "evaluation_split")]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fields])
    size = queries.agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") < least) | (F.col("n") > most)).select(F.lit("number of questions").alias("rule"), F.col("n").cast("string").alias("id"))
    return violations(
        duplicate_ids(queries, "query_id", "unique id"),
        failing(queries, "query_id", whole, "missing field"),
        orphans(queries, "expected_relevant_passage_ids", passages, "passage_id", "unknown passage", "query_id"),
        orphans(queries, "expected_entity_ids", entities, "entity_id", "unknown entity", "query_id"),
        failing(queries, "query_id", ~F.col("expected_answerable") | (F.size("expected_relevant_passage_ids") > 0), "answerable without gold"),
        size,
    )


def combined_traces(traces: dict[str, DataFrame], limit: int = 5) -> DataFrame:
    """query_id and, for each method, its first ids: methods side by side."""
    parts = [t.select("query_id", F.slice("ranked", 1, limit).alias(name)) for name, t in traces.items()]
    return reduce(lambda a, b: a.join(b, "query_id", "full"), parts)


def save_tokenizer(spark: SparkSession, path: str, kind: str, vocab: dict[str, int], merges: list[tuple[str, str]] = ()) -> None:
    """One JSON row; kind is `char` or `bpe`. A vocabulary is small enough for a row."""
    row = json.dumps({"type": kind, "special": list(SPECIAL), "num_merges": len(merges), "merges": [list(m) for m in merges], "vocab": vocab}, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(row,)], "value string").write.mode("overwrite").text(path)


def load_tokenizer(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    got = json.loads(spark.read.text(path).first().value)
    if got["type"] != kind:
        raise ValueError(f"{path} holds a {got['type']} tokenizer, not {kind}")
    return got["vocab"], [tuple(m) for m in got["merges"]]


def append_log(spark: SparkSession, path: str, run: dict) -> None:
    """A run's figures as one more JSON line."""
    spark.createDataFrame([(json.dumps(run, sort_keys=True),)], "value string").write.mode("append").text(path)
