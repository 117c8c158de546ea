"""Structured evidence of questions, and answers that use it.

A question's evidence comes from the entities it mentions and their neighbours, from events of the type and years
it names, and from places it holds the name of. Null questions have none; a blank question is not answered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import retrieval as R
from .lookup import held_names, overlapping

#: Two years of a range, and terms of events with their types, in the order in which they are tried.
YEAR_RANGE = r"(?i)(?<![\p{L}\p{N}_])(1[0-9]{3}|20[0-2][0-9])\s*(?:-|–|to|and)\s*(1[0-9]{3}|20[0-2][0-9])(?![\p{L}\p{N}_])"
EVENT_TERMS = {
    "demolish": "demolition",
    "demolished": "demolition",
    "construction": "construction",
    "constructed": "construction",
    "built": "construction",
    "opened": "opening",
    "opening": "opening",
    "closed": "closure",
    "closure": "closure",
    "renamed": "renaming",
    "relocated": "relocation",
    "heritage": "heritage_listing",
}
FUSED, CANDIDATES = 50, 10


@dataclass(frozen=True)
class Facts:
    """entities (entity_id, name, aliases), entity_passages (entity_id, id), edges (a, b) of entity ids, events (event_id,
    event_type, start_year, end_year), event_passages (event_id, id), places (place_id, name, suburb, address), place_passages (place_id, id)."""

    entities: DataFrame
    entity_passages: DataFrame
    edges: DataFrame
    events: DataFrame
    event_passages: DataFrame
    places: DataFrame
    place_passages: DataFrame


def event_type(question: Column) -> Column:
    """The type of the first term, in their order, that a word of the question starts with; else null."""
    out = F.lit(None).cast("string")
    for term, kind in reversed(EVENT_TERMS.items()):
        out = F.when(F.lower(question).rlike(rf"(?<![\p{{L}}\p{{N}}_]){term}"), kind).otherwise(out)
    return out


def year_range(question: Column) -> tuple[Column, Column]:
    """The two years of the first range; a single year is none."""
    return tuple(F.nullif(F.regexp_extract(question, YEAR_RANGE, k), F.lit("")).cast("int") for k in (1, 2))


def _asked(queries: DataFrame) -> DataFrame:
    low, high = year_range(F.col("question"))
    return queries.filter("question IS NOT NULL").select("query_id", "question", event_type(F.col("question")).alias("want"), low.alias("low"), high.alias("high"))


def _events(asked: DataFrame, facts: Facts) -> DataFrame:
    """query_id, event_id of the type and the years that questions (query_id, want, low, high) name."""
    typed = asked.filter("want IS NOT NULL").join(facts.events, F.col("want") == F.col("event_type"))
    end = F.coalesce("end_year", "start_year")
    in_years = F.col("low").isNull() | ((F.col("start_year") <= F.col("high")) & (end >= F.col("low")))
    dated = overlapping(facts.events, asked.filter("want IS NULL AND low IS NOT NULL"))
    return typed.filter(F.coalesce(in_years, F.lit(False))).select("query_id", "event_id").unionByName(dated.select("query_id", "event_id"))


def evidence_of_pairs(pairs: DataFrame, queries: DataFrame, facts: Facts) -> DataFrame:
    """Those of the pairs (query_id, id) that are evidence by detect(); what else would be is not listed.

    Questions that name the same type and years share their events. pairs should be a table that is there already.
    """
    asked = _asked(queries)
    pairs = pairs.select("query_id", "id").distinct()
    ids = pairs.select("id").distinct()
    found = R.mentions(asked.select("query_id", "question"), facts.entities)

    nodes = R.graph_evidence(found.select("query_id", F.col("entity_id").alias("node")).distinct(), facts.edges)
    near = facts.entity_passages.join(ids, "id", "left_semi")
    by_entity = nodes.join(near, nodes["node"] == near["entity_id"]).select("query_id", "id").distinct().join(pairs, ["query_id", "id"], "left_semi")

    same = ["want", "low", "high"]
    kinds = asked.filter("want IS NOT NULL OR low IS NOT NULL").select(*same, F.struct(*same).alias("kind")).distinct()
    events = facts.events.join(facts.event_passages.select("event_id").distinct(), "event_id", "left_semi")
    # Whether a kind has any event with a passage, from the types and years that events have.
    years = events.select("event_type", "start_year", "end_year").distinct().withColumn("event_id", F.struct("event_type", "start_year", "end_year"))
    any_event = _events(kinds.withColumn("query_id", F.col("kind")), Facts(facts.entities, facts.entity_passages, facts.edges, years, facts.event_passages, facts.places, facts.place_passages)).select(F.col("query_id").alias("kind")).distinct()
    held = facts.event_passages.join(ids, "id", "left_semi")
    close = Facts(facts.entities, facts.entity_passages, facts.edges, facts.events.join(held.select("event_id").distinct(), "event_id", "left_semi"), held, facts.places, facts.place_passages)
    by_kind = _events(kinds.withColumn("query_id", F.col("kind")), close).join(held, "event_id").select(F.col("query_id").alias("kind"), "id").distinct()
    kind_of = asked.select("query_id", F.struct(*same).alias("kind"))
    by_event = pairs.join(kind_of, "query_id").join(by_kind, ["kind", "id"]).select("query_id", "id")

    both = by_entity.withColumn("e", F.lit(1)).join(by_event.withColumn("v", F.lit(1)), ["query_id", "id"], "full")
    narrowed = found.select("query_id").distinct().join(kind_of.join(any_event, "kind").select("query_id").distinct(), "query_id").withColumn("narrow", F.lit(True))
    kept = both.join(narrowed, "query_id", "left").filter("narrow IS NULL OR (e = 1 AND v = 1)").select("query_id", "id")
    by_place = _held_places(asked, facts).join(facts.place_passages, "place_id").select("query_id", "id").join(pairs, ["query_id", "id"], "left_semi")
    return kept.unionByName(by_place).distinct()


def _held_places(asked: DataFrame, facts: Facts) -> DataFrame:
    terms = facts.places.select("place_id", F.explode(F.array("name", "suburb", "address")).alias("name")).withColumnRenamed("place_id", "name_id")
    return held_names(asked.select(F.col("query_id").alias("text_id"), F.col("question").alias("text")), terms).withColumnsRenamed({"text_id": "query_id", "name_id": "place_id"})


def detect(queries: DataFrame, facts: Facts) -> tuple[DataFrame, DataFrame]:
    """Evidence (query_id, id), and for each question (query_id, question) its entity_ids (sorted) and filters in order.

    Events narrow what entities gave if both found anything, and else add to it; places always add.
    """
    asked = _asked(queries)
    found = R.mentions(asked.select("query_id", "question"), facts.entities)
    nodes = R.graph_evidence(found.select("query_id", F.col("entity_id").alias("node")).distinct(), facts.edges)
    by_entity = nodes.join(facts.entity_passages, nodes["node"] == facts.entity_passages["entity_id"]).select("query_id", "id").distinct()
    by_event = _events(asked, facts).join(facts.event_passages, "event_id").select("query_id", "id").distinct()

    both = by_entity.withColumn("e", F.lit(1)).join(by_event.withColumn("v", F.lit(1)), ["query_id", "id"], "full")
    narrowed = found.select("query_id").distinct().join(by_event.select("query_id").distinct(), "query_id").withColumn("narrow", F.lit(True))
    kept = both.join(narrowed, "query_id", "left").filter("narrow IS NULL OR (e = 1 AND v = 1)").select("query_id", "id")

    held = _held_places(asked, facts)
    by_place = held.join(facts.place_passages, "place_id").select("query_id", "id")

    label = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    notes = found.select("query_id", F.lit(0).alias("k"), F.format_string("%012d", "start").alias("o"), label("entity", F.col("name")).alias("f"))
    notes = notes.unionByName(asked.filter("low IS NOT NULL").select("query_id", F.lit(1).alias("k"), F.lit("").alias("o"), F.format_string("date:%d-%d", "low", "high").alias("f")))
    notes = notes.unionByName(asked.filter("want IS NOT NULL").select("query_id", F.lit(2).alias("k"), F.lit("").alias("o"), label("event", F.col("want")).alias("f")))
    notes = notes.unionByName(held.join(facts.places, "place_id").select("query_id", F.lit(3).alias("k"), F.col("place_id").cast("string").alias("o"), label("geo", F.coalesce("name", F.lit("None"))).alias("f")))
    filters = notes.groupBy("query_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "o", "f"))), lambda x: x["f"])).alias("filters"))
    ids = found.groupBy("query_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    none = F.array().cast("array<string>")
    signal = queries.join(ids, "query_id", "left").join(filters, "query_id", "left").select("query_id", "question", F.coalesce("entity_ids", none).alias("entity_ids"), F.coalesce("filters", none).alias("filters"))
    return kept.unionByName(by_place).distinct(), signal


def answer(passages: DataFrame, queries: DataFrame, facts: Facts, p: tuple[str, str], lexical_weight: float = 1.0) -> DataFrame:
    """query_id, id, score, rank: CANDIDATES passages of each question (query_id, question) that is not blank.

    Names widen the question; sparse and hashed rankings of the widened question are fused; evidence of the question
    as it was asked adds a bonus; the widened question's TF-IDF similarity adds the rest.
    """
    queries = queries.filter(F.trim("question") != "")
    wide = R.expand_queries(queries, R.mentions(queries, facts.entities)).select("query_id", F.col("transformed_query").alias("text"))
    q = ("query_id", "text")
    sparse = R.bm25_search(passages, wide, p, q, FUSED).select("query_id", "id", "rank")
    hashed = R.hashed_search(passages, wide, p, q, FUSED).select("query_id", "id", "rank")
    fused = checkpointed(R.top_k(R.fuse(sparse.unionByName(hashed)), "query_id", "id", CANDIDATES).select("query_id", "id", "score"))  # read four times
    evidence = evidence_of_pairs(fused, queries, facts)
    placed = R.structured_rerank(fused, evidence).select("query_id", "id", "score")
    lexical = R.tfidf_of_pairs(fused, passages, wide, p, q)
    return R.top_k(R.lexical_rerank(placed, lexical, lexical_weight), "query_id", "id", CANDIDATES)
