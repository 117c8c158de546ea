"""The whole preparation of a few records, against what the rules give by hand."""

import pytest

from lorespark.sources.corpus import Corpus
from lorespark.sources.prepare import prepare_corpus

FILLER = " ".join(f"plain{k % 50} words{k % 7}" for k in range(60)) + "."
SCHEMA = "source_id string, source_name string, page_title string, source_url string, licence string, retrieved_at string, content_hash string, text string, extra int"


def _record(id_, title, licence, text):
    return (id_, None, title, f"https://example.org/{id_}", licence, "2024-01-01", f"hash-{id_}", text, 1)


RECORDS = [
    _record("s1", "Grand Hotel", "CC-BY-4.0", "The Grand Hotel was demolished in 1955 after a long debate.\n" + FILLER),
    _record("s2", "Windsor House", "CC-BY-4.0", "Late in 1890 the Windsor House was opened by the river for all.\n" + FILLER),
    _record("s3", "Old Mill", "unclear", FILLER),
    _record("s4", "Short", "CC-BY-4.0", "Too short."), _record("s5", None, None, None), _record(None, "None", "CC-BY-4.0", FILLER),
]


@pytest.fixture(scope="module")
def prepared(spark):
    return prepare_corpus(spark.createDataFrame(RECORDS, SCHEMA))


def test_tables(spark, prepared, tmp_path):
    corpus, left_out = prepared
    assert corpus.violations().collect() == []
    assert {(r.source_id, r.title) for r in corpus.documents.collect()} == {("s1", "Grand Hotel"), ("s2", "Windsor House"), ("s3", "Old Mill")}
    assert {(r.event_type, r.date_original) for r in corpus.events.collect()} == {("demolition", "1955"), ("opening", "1890")}
    assert {r.predicate for r in corpus.claims.collect()} >= {"was_demolished", "demolished_in"}
    assert {(r.source_id, r.category) for r in left_out.collect()} == {("s3", "training_licence_exclusion"), ("s4", "insufficient_historical_content"), ("s5", "insufficient_historical_content")}
    assert {r.table: r.n for r in corpus.counts().collect()}["splits"] == 3
    corpus.save(str(tmp_path))
    assert Corpus.load(spark, str(tmp_path)).passages.count() == corpus.passages.count()


def test_no_records(spark):
    corpus, left_out = prepare_corpus(spark.createDataFrame([], SCHEMA))
    assert left_out.count() == 0
    assert {r.rule for r in corpus.violations().collect()} == {"documents missing", "passages missing"}
