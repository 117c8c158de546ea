"""Extraction over sentences made of nation and region names, whose outcome is known by construction, and over all documents.

The queries named *_of_documents cut every whole text into passages; the name of its source is a document's title, as
the table has none. They have no SQL: tests/test_extract.py holds them against rules applied by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import extract as X
from ..operators import windows as W
from ..session import checkpointed
from . import sql as S

YEAR = "(1850 + n_nationkey)"


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A document and a passage for each nation."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumns({"name": F.concat(F.lit("Nat"), F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij")), "year": F.expr(f"cast({YEAR} as string)"), "later": F.expr("cast(1950 + n_nationkey as string)")})
    documents = n.select(F.format_string("doc_%02d", "n_nationkey").alias("document_id"), F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("source_id"), F.concat("name", F.lit(" Hotel")).alias("title"), F.lit("https://example.org/").alias("source_url"))
    said = F.concat_ws(
        "\n", F.concat(F.lit("The "), "name", F.lit(" Hotel was constructed in "), "year", F.lit(" on a site by the river.")),
        F.concat(F.lit("The "), "name", F.lit(" Hotel was designed by "), "name", F.lit(" Partners after a long contest.")),
        F.concat(F.lit("In late 1890s the "), "name", F.lit(" Hotel was closed for a while.")),
        F.concat(F.lit("In "), "later", F.lit(" the "), "name", F.lit(" Hotel was demolished despite many protests.")),
        F.concat(F.lit("A museum there was never built as people say.")), F.concat(F.lit("The "), "name", F.lit(" Hotel is located in Carlton near the old water tower.")), F.concat(F.lit("Coordinates: -37."), F.lpad(F.col("n_nationkey").cast("string"), 4, "8"), F.lit("; 144.9000")),
    )
    passages = n.select(F.format_string("pass_%02d", "n_nationkey").alias("passage_id"), F.format_string("doc_%02d", "n_nationkey").alias("document_id"), F.lit(0).alias("passage_index"), said.alias("text"))
    return documents, passages


def _all(spark: SparkSession, sf_dir: str):
    documents, passages = _corpus(spark, sf_dir)
    found = X.entities(documents, passages)
    events = X.events(passages, found)
    relations, merged = X.relations(passages, found)
    return documents, passages, merged, events, relations.unionByName(X.event_relations(events))


def entities_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, merged, _, _ = _all(spark, sf_dir)
    return merged.select("entity_id", "canonical_name", "entity_type", "confidence", "extraction_method", F.size("supporting_passage_ids").cast("long").alias("supports"))


def events_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, passages = _corpus(spark, sf_dir)
    e = X.events(passages, X.entities(documents, passages))
    return e.select("event_type", F.get("supporting_passage_ids", F.lit(0)).alias("passage_id"), F.get("involved_entity_ids", F.lit(0)).alias("entity_id"), "date_original", F.col("normalised_date.start_year").alias("start_year"), "confidence")


def relations_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, relations = _all(spark, sf_dir)
    return relations.select("relation_type", "subject_entity_id", "object_entity_id", "object_value", F.get("supporting_passage_ids", F.lit(0)).alias("passage_id"))


def claims_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, passages, merged, events, relations = _all(spark, sf_dir)
    c = X.claims(events, relations, merged, passages, documents)
    return c.select("predicate", "passage_id", "source_id", "value_kind", "value_string", F.col("value_entity.name").alias("value_name"), "temporal_qualifier", "geographic_qualifier", "valid")


def places_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, passages = _corpus(spark, sf_dir)
    p = X.places(documents, passages, X.entities(documents, passages))
    return p.select("id", F.col("properties.name").alias("name"), F.get("geometry.coordinates", F.lit(0)).alias("lon"), F.get("geometry.coordinates", F.lit(1)).alias("lat"), F.col("properties.suburb").alias("suburb"))


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents (document_id, source_id, title, source_url) and their passages."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id IS NOT NULL")
    key = F.col("doc_id").cast("string").alias("document_id")
    documents = d.select(key, F.col("source").alias("source_id"), F.coalesce("source", F.lit("")).alias("title"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("source_url"))
    passages = W.passages(d.select(key, F.coalesce("text", F.lit("")).alias("cleaned_text"))).select("passage_id", "document_id", "passage_index", "text")
    return documents, checkpointed(passages)  # every rule reads them


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents, passages = _documents(spark, sf_dir)
    return documents, passages, checkpointed(X.entities(documents, passages))


def entities_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, passages, found = _found(spark, sf_dir)
    _, merged = X.relations(passages, found)
    return merged.select("entity_id", "canonical_name", "entity_type", "confidence", "extraction_method", F.size("supporting_passage_ids").cast("long").alias("supports"))


def events_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, passages, found = _found(spark, sf_dir)
    e = X.events(passages, found)
    return e.select("event_id", "event_type", F.get("supporting_passage_ids", F.lit(0)).alias("passage_id"), F.get("involved_entity_ids", F.lit(0)).alias("entity_id"), "date_original", F.col("normalised_date.start_year").alias("start_year"), "supporting_text")


def relations_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, passages, found = _found(spark, sf_dir)
    relations, _ = X.relations(passages, found)
    return relations.select("relation_type", "subject_entity_id", "object_entity_id", F.get("supporting_passage_ids", F.lit(0)).alias("passage_id"))


def places_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, passages, found = _found(spark, sf_dir)
    p = X.places(documents, passages, found)
    return p.select("id", F.col("properties.name").alias("name"), "geometry.coordinates", F.col("properties.suburb").alias("suburb"))


def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("Hotel", "Railway Station", "Town Hall", "Council", "Road", "House")))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n"), F.concat_ws(" ", F.initcap(F.lower("n_name")), F.get(kinds, F.col("n_nationkey") % 6)).alias("name"))
    return n.select("n", "name", X.entity_type(F.col("name")).alias("entity_type"))


def date_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("y", F.year("o_orderdate").cast("string"))
    s = F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("It opened in "), "y")).when(F.col("o_custkey") % 4 == 1, F.concat(F.lit("Around "), "y", F.lit(" it moved"))).when(F.col("o_custkey") % 4 == 2, F.concat(F.lit("From 1850 it was closed until "), "y")).otherwise("No date at all")
    r = o.select("o_orderkey", s.alias("s")).select("o_orderkey", X.dates(F.col("s"), F.lit(15)).alias("d"))
    return r.select("o_orderkey", "d.date_original", F.col("d.normalised_date.start_year").alias("start_year"), F.col("d.note").alias("note"))


NAT = f"""n AS (SELECT n_nationkey AS k, n_regionkey AS r, 'Nat' || translate(n_nationkey::VARCHAR, '0123456789', 'abcdefghij') AS name, printf('pass_%02d', n_nationkey) AS passage_id, {YEAR}::VARCHAR AS y, (1950 + n_nationkey)::VARCHAR AS l FROM nation),
h AS (SELECT *, {S.stable_id('ent', "'hotel'", "name || ' Hotel'")} AS hotel, {S.stable_id('ent', "'organisation'", "name || ' Partners'")} AS firm, {S.stable_id('ent', "'suburb'", "'Carlton'")} AS carlton FROM n)"""

QUERIES = {f.__name__: f for f in (entities_of_documents, events_of_documents, relations_of_documents, places_of_documents, entities_merged, events_nearest, relations_found, claims_made, places_found, entity_types, date_records)}

ORACLE_SQL = {
    "entities_merged": f"""WITH {NAT} SELECT hotel AS entity_id, name || ' Hotel' AS canonical_name, 'hotel' AS entity_type, 0.98::DOUBLE AS confidence, 'document_title_rule_v1' AS extraction_method, 1::BIGINT AS supports FROM h
UNION ALL SELECT firm, name || ' Partners', 'organisation', 0.82, 'relation_target_rule_v1', 1 FROM h UNION ALL SELECT any_value(carlton), 'Carlton', 'suburb', 0.92, 'place_lexicon_v1', count(*) FROM h""",
    "events_nearest": f"""WITH {NAT} SELECT 'construction' AS event_type, passage_id, hotel AS entity_id, y AS date_original, y::INT AS start_year, 0.86::DOUBLE AS confidence FROM h
UNION ALL SELECT 'closure', passage_id, hotel, 'late 1890s', NULL, 0.86 FROM h UNION ALL SELECT 'demolition', passage_id, hotel, l, l::INT, 0.86 FROM h""",
    "relations_found": f"""WITH {NAT} SELECT 'DESIGNED_BY' AS relation_type, hotel AS subject_entity_id, firm AS object_entity_id, NULL::VARCHAR AS object_value, passage_id FROM h
UNION ALL SELECT 'LOCATED_IN', hotel, carlton, NULL, passage_id FROM h UNION ALL SELECT 'DEMOLISHED_IN', hotel, NULL, l, passage_id FROM h""",
    "claims_made": f"""WITH {NAT} SELECT 'was_constructed' AS predicate, passage_id, 's' || r AS source_id, 'string' AS value_kind, y AS value_string, NULL::VARCHAR AS value_name, y AS temporal_qualifier, NULL::VARCHAR AS geographic_qualifier, true AS valid FROM h
UNION ALL SELECT 'closed', passage_id, 's' || r, 'string', 'late 1890s', NULL, 'late 1890s', NULL, true FROM h UNION ALL SELECT 'was_demolished', passage_id, 's' || r, 'string', l, NULL, l, NULL, true FROM h
UNION ALL SELECT 'designed_by', passage_id, 's' || r, 'entity', NULL, name || ' Partners', NULL, NULL, true FROM h UNION ALL SELECT 'located_in', passage_id, 's' || r, 'entity', NULL, 'Carlton', NULL, 'Carlton', true FROM h
UNION ALL SELECT 'demolished_in', passage_id, 's' || r, 'string', l, NULL, NULL, NULL, true FROM h""",
    "places_found": f"WITH {NAT} SELECT hotel AS id, name || ' Hotel' AS name, 144.9::DOUBLE AS lon, ('-37.' || lpad(k::VARCHAR, 4, '8'))::DOUBLE AS lat, 'Carlton' AS suburb FROM h",
    "entity_types": "SELECT n_nationkey::BIGINT AS n, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || ['Hotel', 'Railway Station', 'Town Hall', 'Council', 'Road', 'House'][n_nationkey % 6 + 1] AS name, ['hotel', 'railway_station', 'building', 'government_institution', 'street', 'building'][n_nationkey % 6 + 1] AS entity_type FROM nation",
    "date_records": """SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN y WHEN 1 THEN 'Around ' || y WHEN 2 THEN y END AS date_original, CASE WHEN o_custkey % 4 IN (0, 2) THEN y::INT END AS start_year,
CASE o_custkey % 4 WHEN 1 THEN 'historical expression retained; precision is not sufficient to normalise' WHEN 3 THEN 'date not stated in supporting text' END AS note FROM (SELECT *, year(o_orderdate)::VARCHAR AS y FROM orders)""",
}
