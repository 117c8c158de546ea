"""Raw records to a prepared corpus: cleaning, passages, extraction, splits, and what was left out.

Records have source_id (unique), source_name, page_title, source_url, licence, retrieved_at, content_hash and text.

Rows: a record without source_id is left out; a null text is an empty one; a document of too few words is no document of
the corpus but an exclusion, however long its record; other columns of records are ignored; without records all tables
are empty, and the corpus breaks the rules that ask for documents and passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from ..operators import quality as QA
from ..operators import windows as W
from ..session import checkpointed
from .corpus import Corpus

#: Categories of exclusions, and their reasons.
REASONS = {
    "insufficient_historical_content": "fewer than 80 usable source words remained after deterministic cleaning",
    "training_licence_exclusion": "licence is unclear or incompatible with training",
    "unsupported_claim_rejected": "supporting span did not exactly match the source passage",
}


def create_documents(records: DataFrame) -> DataFrame:
    """Documents of all records, usable or not, with cleaned text and sizes; usable says whether they stay."""
    known = records.filter("source_id IS NOT NULL")
    cleaned = W.clean_lines(known.withColumn("text", F.coalesce("text", F.lit(""))), "source_id", "text", "source_id")
    rows = known.drop("text").join(cleaned.select("source_id", "cleaned_text"), "source_id").withColumn("word_count", T.word_count("cleaned_text"))
    return rows.select(
        T.stable_id("doc", "source_id", "content_hash").alias("document_id"), "source_id", T.document_title("page_title", "source_id").alias("title"), "source_url",
        F.coalesce("source_name", "source_id").alias("source_name"), "licence", "retrieved_at", "content_hash", "cleaned_text", "word_count",
        T.approximate_tokens(F.col("word_count")).alias("approximate_token_count"), QA.usable("cleaned_text").alias("usable"),
    )


def exclusions(documents: DataFrame, claims: DataFrame, licences: tuple[str, ...] = QA.TRAINING_LICENCES) -> DataFrame:
    """exclusion_id, source_id, category, reason: short documents, licences, claims whose span does not hold their text.

    Lines that cleaning removes are not listed one by one.
    """

    def of(rows: DataFrame, category: str, key: str, tag: str) -> DataFrame:
        return rows.select(T.stable_id("exc", key, F.lit(tag)).alias("exclusion_id"), "source_id", F.lit(category).alias("category"), F.lit(REASONS[category]).alias("reason"))

    unclear = ~F.coalesce(F.col("licence").isin(*licences), F.lit(False))
    return (
        of(documents.filter("NOT usable"), "insufficient_historical_content", "source_id", "empty")
        .unionByName(of(documents.filter(F.col("usable") & unclear), "training_licence_exclusion", "source_id", "licence"))
        .unionByName(of(claims.filter("NOT valid"), "unsupported_claim_rejected", "claim_id", "unsupported"))
    )


def prepare_corpus(records: DataFrame, rules: X.Rules = X.Rules()) -> tuple[Corpus, DataFrame]:
    """The corpus of the records, and the exclusions. Tables that several others read are written once."""
    everything = checkpointed(create_documents(records))
    documents = everything.filter("usable").drop("usable")
    passages = checkpointed(W.passages(documents))
    found = checkpointed(X.entities(documents, passages, rules))
    events = checkpointed(X.events(passages, found, rules))
    said, merged = X.relations(passages, found, rules)
    merged = checkpointed(merged)
    relations = checkpointed(said.unionByName(X.event_relations(events)))
    claims = checkpointed(X.claims(events, relations, merged, passages, documents, rules))
    places = checkpointed(X.places(documents, passages, merged, rules))
    corpus = Corpus(documents, passages, merged, events, relations, claims.filter("valid"), places, QA.splits(documents, "document_id"))
    return corpus, exclusions(everything, claims)
