"""Structured evidence, answers, names in texts, and fixed outputs of the text functions."""

import json
import re

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import evaluate, extract, lm, lookup, retrieval, structured


@pytest.fixture(scope="module")
def facts(spark):
    make = spark.createDataFrame
    return structured.Facts(
        make([("e1", "Grand Hotel", ["The Grand"]), ("e2", "Smith & Co", []), ("e3", "Town Hall", None)], "entity_id string, name string, aliases array<string>"),
        make([("e1", 1), ("e1", 2), ("e2", 3), ("e3", 4)], "entity_id string, id long"),
        make([("e1", "e2")], "a string, b string"),
        make([(1, "demolition", 1955, None), (2, "demolition", 1900, None), (3, "opening", 1950, 1960), (4, "opening", None, None)], "event_id long, event_type string, start_year int, end_year int"),
        make([(1, 2), (1, 9), (2, 1), (3, 8), (4, 7)], "event_id long, id long"),
        make([(1, "Old Mill", "Carlton", None), (2, None, "", "12 High St")], "place_id int, name string, suburb string, address string"),
        make([(1, 50), (2, 51)], "place_id int, id long"),
    )


def by_hand(question):
    """Evidence and filters of the fixture's facts."""
    low, ids, filters = (question or "").lower(), set(), []
    spans = []
    for e, names, own in (("Grand Hotel", ("grand hotel", "the grand"), {1, 2, 3}), ("Smith & Co", ("smith & co",), {1, 2, 3}), ("Town Hall", ("town hall",), {4})):
        spans += [(-len(n), m.start(), e, own) for n in names for m in re.finditer(rf"\b{re.escape(n)}\b", low)]
    kept = []
    for s in sorted(spans, key=lambda s: (s[0], s[1], s[2])):
        if all(s[1] - s[0] <= k[1] or k[1] - k[0] <= s[1] for k in kept):
            kept.append(s)
    for _, _, e, own in sorted(kept, key=lambda s: s[1]):
        ids |= own
        filters.append(f"entity:{e}")
    kind = next((v for t, v in structured.EVENT_TERMS.items() if re.search(rf"\b{t}\w*\b", low)), None)
    years = re.search(r"\b(1[0-9]{3}|20[0-2][0-9])\s*(?:-|–|to|and)\s*(1[0-9]{3}|20[0-2][0-9])\b", question or "", re.I)
    a, b = map(int, years.groups()) if years else (None, None)
    filters += [f"date:{a}-{b}"] * bool(years) + [f"event:{kind}"] * bool(kind)
    if kind or years:
        events = {("demolition", 1955, 1955): {2, 9}, ("demolition", 1900, 1900): {1}, ("opening", 1950, 1960): {8}, ("opening", None, None): {7}}
        found = set().union(*[v for (k, s, e), v in events.items() if (not kind or k == kind) and (not years or (s is not None and s <= b and e >= a))])
        ids = ids & found if kept and found else ids | found
    for name, terms, own in (("Old Mill", ("old mill", "carlton"), 50), ("None", ("12 high st",), 51)):
        if any(t in low for t in terms):
            ids.add(own)
            filters.append(f"geo:{name}")
    return ids, list(dict.fromkeys(filters))


QUESTIONS = [
    "When was the Grand Hotel demolished?", "What was demolished between 1950 and 1960?", "demolished 1955", "Grand Hotels in Carltonian style", "the grand hotel and Smith & Co opened 1890-1900", "what opened", "Old mill at 12 High St, 1950 to 1951", "town hall construction 1999 and 2001",
    "", None, "the grand the grand hotel town hall", "undemolished reopened", "years 1960 and 1950", "1850–2010",
]


def test_detection_by_hand(spark, facts):
    queries = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, question string")
    evidence, signal = structured.detect(queries, facts)
    got = {k: set() for k in range(len(QUESTIONS))}
    for r in evidence.collect():
        got[r.query_id].add(r.id)
    filters = {r.query_id: r.filters for r in signal.collect()}
    for k, q in enumerate(QUESTIONS):
        assert (got[k], filters[k]) == by_hand(q), q
    none = spark.createDataFrame([], "query_id long, question string")
    assert structured.detect(none, facts)[0].count() == 0


def test_answers_use_evidence_and_skip_blanks(spark, facts):
    docs = spark.createDataFrame([(k, f"a note on the hotel number {k}") for k in range(1, 12)] + [(20, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "note on the grand hotel demolished"), (2, "   "), (3, None)], "query_id long, question string")
    rows = structured.answer(docs, queries, facts, ("doc_id", "text")).collect()
    assert {r.query_id for r in rows} == {1} and min(rows, key=lambda r: r["rank"]).id in {1, 2}


def test_names_inside_words_are_held(spark):
    texts = spark.createDataFrame([(1, "A Carltonian at xOld Hall"), (2, "car"), (3, None), (4, "")], "text_id long, text string")
    names = spark.createDataFrame([("a", "Carlton"), ("b", "Old Hall"), ("c", "r"), ("d", ""), ("e", None), ("f", "car")], "name_id string, name string")
    got = {(r.text_id, r.name_id) for r in lookup.held_names(texts, names).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (2, "c"), (1, "f"), (2, "f")}
    found = names.select(F.col("name_id").alias("entity_id"), F.col("name").alias("canonical_name"), F.lit("place").alias("entity_type"))
    mentioned = extract.passage_mentions(texts.select(F.col("text_id").alias("passage_id"), "text"), found)
    assert {(r.passage_id, r.entity_id) for r in mentioned.collect()} == {(1, "a"), (1, "b"), (1, "f"), (2, "f")}


def test_ranges_meet_once(spark):
    rows = spark.createDataFrame([(1, 1895, 1925), (2, 1900, None), (3, None, None), (4, 1990, 1980)], "id int, start_year int, end_year int")
    ranges = spark.createDataFrame([(1, 1890, 1930), (2, 1920, 1920), (3, 1930, 1890), (4, None, 1900)], "q int, low int, high int")
    assert sorted((r.id, r.q) for r in lookup.overlapping(rows, ranges).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_longest_name_is_by_characters(spark):
    q = spark.createDataFrame([(1, "a b c supercalifragilistic")], "query_id int, question string")
    e = spark.createDataFrame([("x", "b c", []), ("y", "c supercalifragilistic", []), ("z", "b. c", [])], "entity_id string, name string, aliases array<string>")
    assert [(r.entity_id, r.start) for r in retrieval.mentions(q, e).collect()] == [("y", 4)]


def test_sparse_search_is_the_scores_top(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"t{(k * j) % 17}" for j in range(1, 9))) for k in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, f"t{k} t{k + 3} t{k + 3} zz") for k in range(12)], "item_id long, text string")
    p, q = ("doc_id", "text"), ("item_id", "text")
    whole = retrieval.top_k(retrieval.bm25_scores(retrieval.bm25_index(docs, *p), retrieval.query_terms(asked, *q)), "query_id", "id", 5)
    want = {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in whole.collect()}
    for blocks in ((4000, 2000), (7, 3)):
        monkeypatch.setattr(retrieval, "PASSAGE_BLOCK", blocks[0])
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", blocks[1])
        assert {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in retrieval.bm25_search(docs, asked, p, q, 5).collect()} == want
    pairs = whole.select("query_id", "id")
    scores = {(r.query_id, r.id): round(r.score, 9) for r in retrieval.tfidf_scores(docs, asked, p, q).collect()}
    got = {(r.query_id, r.id): round(r.score, 9) for r in retrieval.tfidf_of_pairs(pairs, docs, asked, p, q).collect()}
    assert got and all(scores[k] == v for k, v in got.items())


def test_fixed_outputs(spark):
    one = lambda f, *xs: spark.range(1).select(f(*map(F.lit, xs)).alias("x")).first().x
    answer = {"results": {"bindings": [{"a": {"value": "1"}, "b": {"value": "x"}}, {"a": {"value": "2"}}]}}
    assert one(T.bindings_table, json.dumps(answer)) == "a | b\n--- | ---\n1 | x\n2 | "
    assert one(T.bindings_table, '{"results": {"bindings": []}}') == "" == one(T.category_list, '{"query": {"categorymembers": []}}')
    assert one(T.category_list, '{"query": {"categorymembers": [{"title": "A"}, {"title": "B"}]}}') == "# Wikipedia Category Members\n\n- A\n- B"
    assert one(T.html_title, "<title>x</title>", "sparql_json") == "(API response)" == one(T.html_title, "", "wikipedia_api") and one(T.html_title, "<title>x</title>", "sparql") == "x"
    assert one(T.document_title, "Mill  |  PROV", "s") == "Mill" and one(T.document_title, "\n Mill - Wikipedia", "s") == "Mill"
    words = lm.word_freqs(spark.createDataFrame([("It's 1890, isn't it?",)], "t string"), "t")
    assert {r.word for r in words.collect()} == {"It's", "1", "8", "9", "0", ",", "isn't", "it", "?"}
    rows = spark.createDataFrame([(False, True, "alias", True), (False, False, "alias", True), (True, False, "alias x", False), (True, False, "a date", False), (True, True, "location", True), (True, True, "x", True), (True, True, "x", False)], "answerable boolean, abstained boolean, query_type string, has_entities boolean")
    assert [r.c for r in rows.select(evaluate.failure_category().alias("c")).collect()] == ["none", "insufficient_corpus_coverage", "alias_mismatch", "date_filter_failure", "location_ambiguity", "semantic_confusion", "lexical_mismatch"]
