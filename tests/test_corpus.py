"""A corpus of eight tables: sound, broken rule by rule, written and read again; training texts."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lorespark.operators import quality
from lorespark.sources.corpus import Corpus, training_rows, write_training_text

SPAN = "struct<start:int,end:int>"
PLACE = "struct<canonical_entity_id:string,name:string>"


@pytest.fixture(scope="module")
def corpus(spark):
    make = spark.createDataFrame
    return Corpus(
        make([("d1", "s1", "CC-BY-4.0", "The hotel was built in 1890."), ("d2", "s2", "CC-BY-4.0", "More text of it.")], "document_id string, source_id string, licence string, cleaned_text string"),
        make([("p1", "d1", "The hotel was built in 1890."), ("p2", "d2", "More text of it.")], "passage_id string, document_id string, text string"),
        make([("e1", "Hotel", "building", 0.97, ["p1"]), ("e2", "Smith", "person", 0.9, ["p1", "p2"])], "entity_id string, canonical_name string, entity_type string, confidence double, supporting_passage_ids array<string>"),
        make([("v1", "construction", "1890", ["e1"], ["p1"])], "event_id string, event_type string, date_original string, involved_entity_ids array<string>, supporting_passage_ids array<string>"),
        make([("r1", "e1", "e2", ["p1"]), ("r2", "e1", None, ["p1"])], "relation_id string, subject_entity_id string, object_entity_id string, supporting_passage_ids array<string>"),
        make([("c1", "p1", ("e1",), None, (4, 9), "hotel")], f"claim_id string, passage_id string, subject struct<entity_id:string>, value_entity struct<entity_id:string>, supporting_span {SPAN}, supporting_text string"),
        make([("e1", ([144.9, -37.8],), ("e1", "Hotel"))], f"id string, geometry struct<coordinates:array<double>>, properties {PLACE}"),
        make([("d1", "train"), ("d2", "test")], "document_id string, split string"),
    )


def broken(corpus):
    return {(r.rule, r.id) for r in corpus.violations().collect()}


def test_sound_corpus_is_saved_and_loaded(spark, corpus, tmp_path):
    assert broken(corpus) == set()
    corpus.save(str(tmp_path))
    got = Corpus.load(spark, str(tmp_path))
    assert {r.table: r.n for r in got.counts().collect()} == {"documents": 2, "passages": 2, "entities": 2, "events": 1, "relations": 2, "claims": 1, "places": 1, "splits": 2}
    assert [r.entity_id for r in got.samples()["entities"].collect()] == ["e1"]


def test_each_rule(spark, corpus):
    docs = corpus.documents
    bad = replace(
        corpus,
        passages=corpus.passages.unionByName(spark.createDataFrame([("p3", "d9", " "), ("p4", None, "x")], corpus.passages.schema)),
        entities=corpus.entities.unionByName(spark.createDataFrame([("e3", "x", "place", 1.0, []), ("e1", "Hotel", "place", 1.0, ["p8"])], corpus.entities.schema)),
        relations=corpus.relations.withColumn("object_entity_id", F.lit("e7")),
        claims=corpus.claims.withColumn("supporting_text", F.lit("hotels")),
        places=corpus.places.withColumn("geometry", F.expr("named_struct('coordinates', array(181D, 0D))")),
        splits=corpus.splits.filter("document_id = 'd1'").unionByName(corpus.splits.filter("document_id = 'd1'")),
    )
    assert broken(bad) == {
        ("passages document", "p3"), ("passages document", "p4"), ("passages text", "p3"), ("entities id", "e1"), ("entities support", "e1"), ("entities support", "e3"),
        ("relations object", "r1"), ("relations object", "r2"), ("claims span", "c1"), ("places coordinates", "e1"), ("splits id", "d1"), ("document without split", "d2"),
    }
    with pytest.raises(ValueError):
        quality.require_sound(bad.violations())
    assert ("documents missing", None) in broken(replace(corpus, documents=docs.limit(0)))


def test_training_text(spark, tmp_path):
    rows = [("s2", "CC-BY-4.0", "  One two-fold,  o'clock four. "), ("s1", "OGL-AU", "a b"), ("s3", "unclear", "x"), ("s4", None, "x"), ("s5", "OGL-AU", " "), ("s6", "OGL-AU", None)]
    docs = spark.createDataFrame(rows, "source_id string, licence string, cleaned_text string")
    got = {r.source_id: r.training_text for r in training_rows(docs, cap=3).collect()}
    assert got == {"s2": "One two-fold,  o'clock", "s1": "a b"}
    assert training_rows(docs, cap=4).filter("source_id = 's2'").first().training_text == "One two-fold,  o'clock four."
    write_training_text(docs.coalesce(1), str(tmp_path / "t"), cap=3)
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*.txt")))
    assert text == "a b\n\nOne two-fold,  o'clock\n\n"


def test_long_text_is_capped(spark):
    text = "word, " * 20_000
    got = spark.createDataFrame([(text,)], "t string").select(quality.capped_text("t", 6000).alias("t")).first().t
    assert got == ("word, " * 6000)[:-2]
