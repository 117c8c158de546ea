"""Extraction over a table of documents, against what the rules give by hand."""

import pytest

from lorespark.operators import extract
from lorespark.plans import extract_queries as Q

from .conftest import SF

FILLER = " ".join(f"plain{k % 50} words{k % 7}" for k in range(400)) + "."
DOCUMENTS = [
    (1, "The Grand Hotel was demolished in 1955 after a long debate.\n" + FILLER, "en", "Grand Hotel", 0),
    (2, FILLER + "\nThe Grand Hotel was designed by Smith Partners after a contest.", "en", "Grand Hotel", 0),
    (3, "Late in 1890 the Windsor House was opened by the river for all.", "en", "Windsor House", 0),
    (4, None, None, None, None), (5, "", "en", "", 0), (None, "The Grand Hotel was demolished in 1901 by a crowd.", "en", "Grand Hotel", 0),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("extract")
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return str(out)


def test_events_of_documents(spark, folder):
    got = {(r.event_type, r.date_original, r.supporting_text) for r in Q.events_of_documents(spark, folder).collect()}
    assert got == {
        ("demolition", "1955", "The Grand Hotel was demolished in 1955 after a long debate."), ("opening", "1890", "Late in 1890 the Windsor House was opened by the river for all."),
    }


def test_entities_and_relations_of_documents(spark, folder):
    names = {r.canonical_name: (r.entity_type, r.supports) for r in Q.entities_of_documents(spark, folder).collect()}
    assert names["Grand Hotel"][0] == "hotel" and names["Smith Partners"][0] == "organisation" and "Windsor House" in names
    relations = Q.relations_of_documents(spark, folder).collect()
    assert [r.relation_type for r in relations if r.relation_type == "DESIGNED_BY"] == ["DESIGNED_BY"]
    assert Q.places_of_documents(spark, folder).count() == 0


def test_whole_texts_are_cut_into_passages(spark, folder):
    _, passages = Q._documents(spark, folder)
    rows = passages.collect()
    assert {r.document_id for r in rows} == {"1", "2", "3"} and max(r.passage_index for r in rows) >= 1
    found = extract.entities(*Q._documents(spark, folder))
    assert found.count() >= 2


def test_invented_prose_runs(spark):
    assert Q.entities_of_documents(spark, SF).count() > 0 and Q.events_of_documents(spark, SF).count() >= 0
