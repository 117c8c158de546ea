"""Steps that had grown faster than their input, held against plain rules by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.functions.text import search_tokens
from lorespark.operators import counting, lm, lookup, retrieval, structured, windows

from .test_structured import QUESTIONS, facts  # noqa: F401


@pytest.mark.parametrize("letters, most", [("ab", 9), ("abcde", 9), ("abcde", 50_000), ("a", 9)])
def test_merges_learned_on_executors(spark, monkeypatch, letters, most):
    """The same merges, ties too, as from a loop over all words, however few parts of words the driver gets at once."""
    monkeypatch.setattr(lm, "MOST_PARTS", most)
    monkeypatch.setattr(lm, "PENDING", 7)
    rng = random.Random(5)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(150)})
    rng.shuffle(words)
    rows = [(w, rng.choice([1, 1, 2, 3, 9]), (k // 3, k % 3)) for k, w in enumerate(words)]
    freqs = spark.createDataFrame(rows, "word string, n long, first struct<o:long,p:int>").repartition(3)
    assert lm.learn_bpe(freqs, 40) == lm.train_bpe([(w, n) for w, n, _ in rows], 40)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_without_a_shuffle(spark):
    """Postings, n-grams and hashed vectors of a text come from the task that reads it."""
    rows = spark.createDataFrame([(1, "a B b c a b"), (2, ""), (3, None)], "id long, t string")
    grams = windows.ngram_counts(rows, "id", "t", 2)
    assert sorted((r.id, r.ngram, r.n) for r in grams.collect()) == [(1, "a b", 2), (1, "b b", 1), (1, "b c", 1), (1, "c a", 1)]
    postings = retrieval.bm25_index(rows, "id", "t").postings
    assert sorted((r.id, r.term, r.tf, r.len) for r in postings.collect()) == [(1, "a", 2, 6), (1, "b", 3, 6), (1, "c", 1, 6)]
    for df in (grams, postings, retrieval.hashed_arrays(rows, "id", "t")):
        assert "Exchange" not in _plan(df)


def test_bitmap_lets_asked_terms_pass(spark):
    rows = spark.createDataFrame([(k, f"w{k} x{k}'y Z’z") for k in range(50)], "id long, t string")
    asked = spark.createDataFrame([("w7",), ("x9'y",), ("z'z",)], "term string")
    bits = counting.asked_bits(counting.term_bucket("term"), asked)
    got = retrieval.bm25_index(rows, "id", "t", asked=bits).postings.join(asked, "term", "left_semi")
    assert sorted((r.term, r.id) for r in got.collect()) == [("w7", 7), ("x9'y", 9), *(("z'z", k) for k in range(50))]


def test_tfidf_shuffles_all_terms_once(spark):
    rows = spark.createDataFrame([(k, f"tower bridge w{k} tower") for k in range(9)], "id long, t string")
    plan = _plan(retrieval.tfidf_search(rows, rows.filter("id < 2"), ("id", "t"), ("id", "t")))
    assert plan.count("Window [count(1)") == 1 and "df" in plan


def test_dense_search_in_small_pieces(spark, monkeypatch):
    rng = random.Random(3)
    rows = spark.createDataFrame([(k, [float(rng.randint(0, 2)) for _ in range(3)]) for k in range(60)], "id long, vec array<double>")  # many tie
    asked = rows.filter("id % 5 = 0").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, retrieval.dense_search(rows, asked, 4).collect()))
    monkeypatch.setattr(retrieval, "SCORES", 60)
    assert sorted(map(tuple, retrieval.dense_search(rows, asked, 4).collect())) == want
    unit = {r.id: np.array(r.vec) / (np.linalg.norm(r.vec) or 1) for r in rows.collect()}
    for q in (0, 5):
        best = sorted(unit, key=lambda k: (-round(float(unit[q] @ unit[k]), 9), k))[:4]
        assert [x[1] for x in sorted((x for x in want if x[0] == q), key=lambda x: x[3])] == best


def test_a_decade_is_dealt_out(spark):
    """Rows of one year do not all meet a range in one task."""
    rows = spark.range(2000).select(F.col("id"), F.lit(1994).alias("start_year"), F.lit(None).cast("int").alias("end_year"))
    ranges = spark.createDataFrame([(1, 1993, 1995)], "q long, low int, high int")
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(was, ("false", "-1", "8"), strict=True):
        spark.conf.set(k, v)
    try:
        parts = [r["count"] for r in lookup.overlapping(rows, ranges).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sum(parts) == 2000 and max(parts) < 1000


def test_evidence_of_pairs(spark, facts):
    """The pairs that detection lists, of all that there could be."""
    queries = spark.createDataFrame([(k, q) for k, q in enumerate(QUESTIONS)], "query_id long, question string")
    every = structured.detect(queries, facts)[0]
    ids = every.select("id").distinct()
    pairs = queries.select("query_id").crossJoin(ids)
    want = {(r.query_id, r.id) for r in every.collect()}
    assert want and {(r.query_id, r.id) for r in structured.evidence_of_pairs(pairs, queries, facts).collect()} == want
    some = pairs.filter("query_id % 2 = 0")
    assert {(r.query_id, r.id) for r in structured.evidence_of_pairs(some, queries, facts).collect()} == {x for x in want if x[0] % 2 == 0}


def test_texts_give_rows_only_where_a_name_may_start(spark):
    """Not a row for each run of characters; struct ids, short and long names, ends of texts, other planes."""
    texts = spark.createDataFrame([((1, 0), "x" * 3000 + " The Grand Hotel"), ((1, 1), "grand hote"), ((2, 0), "😀 Ödön Straße"), ((2, 1), None), ((3, 0), "")], "text_id struct<id:long,n:int>, text string")
    names = spark.createDataFrame([(1, "grand hotel"), (2, "ödön strasse"), (3, "x"), (4, "😀"), (5, "grand"), (6, None), (7, "")], "name_id long, name string")
    held = lookup.held_names(texts, names)
    assert sorted((r.text_id.id, r.text_id.n, r.name_id) for r in held.collect()) == [(1, 0, 1), (1, 0, 3), (1, 0, 5), (1, 1, 5), (2, 0, 2), (2, 0, 4)]
    assert "Generate" not in _plan(held)
    assert lookup.held_names(texts, names.filter("false")).count() == 0


def test_bigrams_of_texts(spark):
    """As over a row for each token, without a window over a text's tokens."""
    rows = spark.createDataFrame([(1, "a b c a b"), (2, "A b, it’s a b"), (3, ""), (4, None), (5, "z")], "id long, t string")
    tokens = rows.select("id", F.posexplode(search_tokens("t")).alias("n", "token"))
    got = lm.bigram_perplexity_of_texts(rows.filter("id <> 2"), rows.filter("id = 2"), "t")
    want = lm.bigram_perplexity(tokens.filter("id <> 2"), tokens.filter("id = 2"), "id", "n", "token")
    assert got.first().perplexity == pytest.approx(want.first().perplexity, rel=1e-12)
    assert "Window" not in _plan(got)
