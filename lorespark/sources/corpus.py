"""A prepared corpus: its eight tables together, their integrity rules, counts, samples and training text.

Tables: documents (document_id, source_id, licence, cleaned_text), passages (passage_id, document_id, text), entities
(entity_id, supporting_passage_ids), events (event_id, involved_entity_ids, supporting_passage_ids), relations
(relation_id, subject_entity_id, object_entity_id, supporting_passage_ids), claims (claim_id, passage_id,
subject.entity_id, value_entity.entity_id, supporting_span, supporting_text), places (id, geometry,
properties.canonical_entity_id) and splits (document_id, split). Other columns are carried along.

Rows: a null id, reference or span breaks its rule, but for a relation's object, which may be null; an empty text of a
passage does too. Empty tables break no rule, except that documents and passages must have rows.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.quality import SOURCE_WORDS, TRAINING_LICENCES, capped_text, duplicate_ids, failing, orphans, require_sound, row_counts, violations

#: Least confidence of an entity that a report shows, and how many rows of a kind.
SAMPLE_CONFIDENCE = 0.95
SAMPLES = 5
#: Fixed value: text that stands between two documents of the training text.
BETWEEN = "\n\n"
#: The key of each table that must be unique.
KEYS = {"documents": "document_id", "passages": "passage_id", "entities": "entity_id", "events": "event_id", "relations": "relation_id", "claims": "claim_id", "splits": "document_id"}


@dataclass(frozen=True)
class Corpus:
    documents: DataFrame
    passages: DataFrame
    entities: DataFrame
    events: DataFrame
    relations: DataFrame
    claims: DataFrame
    places: DataFrame
    splits: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, root: str, check: bool = True) -> Corpus:
        """The tables of a folder that save() wrote; a missing one fails, and so does a broken rule."""
        corpus = cls(**{f.name: spark.read.parquet(f"{root}/{f.name}") for f in fields(cls)})
        if check:
            require_sound(corpus.violations())
        return corpus

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def save(self, root: str) -> None:
        for name, table in self.tables().items():
            table.write.mode("overwrite").parquet(f"{root}/{name}")

    def counts(self) -> DataFrame:
        """table, n."""
        return row_counts(self.tables())

    def violations(self) -> DataFrame:
        """(rule, id) of every broken rule; all rules are anti-joins and filters, so nothing is gathered."""
        supports = [orphans(getattr(self, t), "supporting_passage_ids", self.passages, "passage_id", f"{t} support", KEYS[t]) for t in ("entities", "events", "relations")]
        unsupported = failing(self.entities, "entity_id", F.size("supporting_passage_ids") > 0, "entities support")
        objects = self.relations.filter("object_entity_id IS NOT NULL")
        claims = self.claims.select("claim_id", "passage_id", F.col("subject.entity_id").alias("_subject"), F.col("value_entity.entity_id").alias("_object"), "supporting_span", "supporting_text")
        quoted = claims.join(self.passages.select("passage_id", F.col("text").alias("_text")), "passage_id", "left")
        start, end = F.col("supporting_span.start"), F.col("supporting_span.end")
        span = (start >= 0) & (start < end) & T.valid_span("_text", start, end, "supporting_text")
        owners = self.places.select("id", F.col("properties.canonical_entity_id").alias("_entity"))
        return violations(
            _nonempty(self.documents, "documents"),
            _nonempty(self.passages, "passages"),
            *[duplicate_ids(getattr(self, t), key, f"{t} id") for t, key in KEYS.items()],
            _unknown(self.passages, "document_id", self.documents, "document_id", "passages document", "passage_id"),
            failing(self.passages, "passage_id", F.col("text").rlike(r"\S"), "passages text"),
            unsupported,
            *supports,
            orphans(self.events, "involved_entity_ids", self.entities, "entity_id", "events entity", "event_id"),
            _unknown(self.relations, "subject_entity_id", self.entities, "entity_id", "relations subject", "relation_id"),
            _unknown(objects, "object_entity_id", self.entities, "entity_id", "relations object", "relation_id"),
            _unknown(claims, "passage_id", self.passages, "passage_id", "claims passage", "claim_id"),
            _unknown(claims, "_subject", self.entities, "entity_id", "claims subject", "claim_id"),
            _unknown(claims.filter("_object IS NOT NULL"), "_object", self.entities, "entity_id", "claims object", "claim_id"),
            failing(quoted, "claim_id", span, "claims span"),
            _unknown(owners, "_entity", self.entities, "entity_id", "places entity", "id"),
            failing(self.places, "id", _on_earth(F.col("geometry.coordinates")), "places coordinates"),
            _unknown(self.splits, "document_id", self.documents, "document_id", "splits document", "document_id"),
            _unknown(self.documents, "document_id", self.splits, "document_id", "document without split", "document_id"),
        )

    def samples(self) -> dict[str, DataFrame]:
        """What a report shows: the first rows of each kind, entities among the surest by type and name."""
        sure = self.entities.filter(F.col("confidence") >= SAMPLE_CONFIDENCE).orderBy("entity_type", "canonical_name", "entity_id")
        dated = self.events.filter("date_original IS NOT NULL")
        return {
            "entities": sure.limit(SAMPLES),
            "events": dated.orderBy("event_id").limit(SAMPLES),
            "relations": self.relations.orderBy("relation_id").limit(SAMPLES),
            "claims": self.claims.orderBy("claim_id").limit(SAMPLES),
        }


def _nonempty(rows: DataFrame, name: str) -> DataFrame:
    none = rows.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return none.select(F.lit(f"{name} missing").alias("rule"), F.lit(None).cast("string").alias("id"))


def _unknown(rows: DataFrame, column: str, parents: DataFrame, key: str, rule: str, own: str) -> DataFrame:
    """Rows whose column is null or no key of parents."""
    ref = rows.select(F.col(own).cast("string").alias("id"), F.col(column).alias("_ref"))
    return ref.join(parents.select(F.col(key).alias("_ref")), "_ref", "left_anti").select(F.lit(rule).alias("rule"), "id").distinct()


def _on_earth(point: Column) -> Column:
    """Is it a longitude and a latitude?"""
    lon, lat = F.get(point, F.lit(0)), F.get(point, F.lit(1))
    return (F.size(point) == 2) & lon.between(-180, 180) & lat.between(-90, 90)


def training_rows(documents: DataFrame, cap: int = SOURCE_WORDS, licences: tuple[str, ...] = TRAINING_LICENCES) -> DataFrame:
    """source_id and training_text of the documents (source_id, licence, cleaned_text) whose licence allows training.

    A text of more than cap words is cut at the cap-th; null and empty texts give no row.
    """
    allowed = documents.filter(F.col("licence").isin(*licences))
    return allowed.select("source_id", capped_text("cleaned_text", cap).alias("training_text")).filter("training_text <> ''")


def write_training_text(documents: DataFrame, path: str, cap: int = SOURCE_WORDS, licences: tuple[str, ...] = TRAINING_LICENCES) -> None:
    """Training texts in the order of source_id with a blank line between, over as many files as a range sort makes."""
    rows = training_rows(documents, cap, licences).orderBy("source_id", "training_text")
    rows.select(F.col("training_text").alias("value")).write.mode("overwrite").option("lineSep", BETWEEN).text(path)
