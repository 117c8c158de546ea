"""Operators on inline rows: nulls, empty texts, repeats, non-ASCII, ties."""

import pytest
from pyspark.sql import functions as F

from lorespark.functions import spans
from lorespark.functions import text as T
from lorespark.operators import evaluate, extract, lm, quality, retrieval, windows
from lorespark.sources import artifacts, collect
from lorespark.streaming import ingest


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_keys_and_names(spark):
    assert one(spark, T.normalise_key, "  Café’s  STRASSE-Weg! ß ") == "café's strasse-weg ss"
    assert one(spark, T.normalise_key, None) is None
    assert one(spark, T.clean_name, "The  Old  Mill, ") == "Old Mill"
    assert one(spark, T.search_tokens, "Don’t re-use it’s 2nd") == ["don't", "re-use", "it's", "2nd"]
    assert one(spark, T.word_count, "It's a well-known “fact”.") == 4
    assert one(spark, T.safe_filename, "a/b c.d") == "a_b_c_d"
    assert one(spark, lambda c: T.duplicate_name_key(c, ("town",)), "Old Mill Town") == "oldmill"


def test_markdown_and_html(spark):
    assert one(spark, T.strip_markdown, "**A** ![p](q) [b](c) [3] <i>d</i> *e* `f` g_h") == "A b d e f g_h"
    assert one(spark, T.html_title, "<TITLE> x </TITLE><title>y</title>") == "x"
    assert one(spark, T.html_title, "<p>none</p>") == "(no title)"
    assert one(spark, T.html_to_text, "<script>a</script><p>b</p>\n\n\n\n<p>c</p>") == "b \n\n c"
    assert one(spark, T.coordinates, "at -37.81361; 144.96306.") == [144.96306, -37.81361]


def test_provenance(spark):
    text = "<!-- PROVENANCE\nsource_id: s\nsource_url: http://a:1/b\npage_title: t: u\nlicence: l\nretrieved: r\ncontent_hash_sha256: h\nhttp_status: 200\n-->\n\nBody"
    p = one(spark, T.parse_provenance, text)
    assert p.valid and p.fields["source_url"] == "http://a:1/b" and p.fields["page_title"] == "t: u" and p.body == "Body"
    assert not one(spark, T.parse_provenance, "no header").valid
    assert not one(spark, T.parse_provenance, "<!-- PROVENANCE\nsource_id: s\n-->\nx").valid


def test_sentences_have_offsets(spark):
    text = "One two three four five. Été six seven eight nine ten!\nToo short. It went to the house of the\nLast line of five words"
    rows = spans.sentences(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "text").orderBy("start").collect()
    assert [r.sentence for r in rows] == ["One two three four five.", "Été six seven eight nine ten!", "Last line of five words"]
    assert all(text[r.start : r.end] == r.sentence for r in rows)


def test_passages_follow_the_window_rule(spark):
    for n in (0, 1, 44, 45, 450, 451, 900, 2000):
        text = "# Head\n" + " ".join(f"w{k}" for k in range(n)) if n else ""
        rows = windows.passages(spark.createDataFrame([("d", text)], "document_id string, cleaned_text string")).orderBy("passage_index").collect()
        words = text.split()
        assert all(len(r.text.split()) <= 450 and text[r.character_start : r.character_end] == r.text for r in rows)
        if words:
            assert rows[0].text.split()[0] == words[0] and rows[-1].text.split()[-1] == words[-1] and rows[0].section_title == "Head"
            assert {w for r in rows for w in r.text.split()} == set(words)


def test_cleaning_keeps_state(spark):
    body = "# A\ntext\n# A\n\n\n\nmore\n[edit]\nCategory: x\n# B"
    r = windows.clean_lines(spark.createDataFrame([(1, body), (2, None)], "id int, t string"), "id", "t").collect()
    assert [(x.id, x.cleaned_text, x.line_count) for x in r] == [(1, "# A\ntext\n\nmore\n# B", 3)]


def test_mentions_prefer_the_longest(spark):
    q = spark.createDataFrame([(1, "Is the Old Town Hall near old town?"), (2, None), (3, "nothing")], "query_id int, question string")
    e = spark.createDataFrame([("a", "Old Town Hall", ["Hall"]), ("b", "Old Town", []), ("c", None, None)], "entity_id string, name string, aliases array<string>")
    got = sorted((r.query_id, r.entity_id, r.position) for r in retrieval.mentions(q, e).collect())
    assert got == [(1, "a", 2), (1, "b", 6)]
    x = {r.query_id: r for r in retrieval.expand_queries(q.filter("question IS NOT NULL"), retrieval.mentions(q, e)).collect()}
    assert x[3].transformed_query == "nothing" and x[1].entity_ids == ["a", "b"]


def test_threshold_and_metrics(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, True), (0.2, False), (0.1, False)], "top_score double, answerable boolean")
    best = evaluate.abstention_threshold(rows).first()
    assert best.threshold == 0.8 and best.quality == 1.0
    ranked = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.5)], "query_id long, id long, rank int, score double")
    gold = spark.createDataFrame([(1, 11)], "query_id long, id long")
    t = evaluate.traces(ranked, gold, spark.createDataFrame([(1,), (2,)], "query_id long")).withColumn("abstained", F.col("top_score") < 0.1)
    m = evaluate.metrics(t).first()
    assert (m.mrr, m.recall_at_1, m.recall_at_3, m.unanswerable_recall) == (0.5, 0.0, 1.0, 1.0)


def test_zero_vectors_and_empty_index(spark, monkeypatch):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None)], "id long, vec array<float>")
    for block in (20_000, 1):
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
        got = {(r.query_id, r.id): (round(r.score, 6), r.rank) for r in retrieval.dense_search(v, v.withColumnRenamed("id", "query_id")).collect()}
        assert got == {(1, 1): (0.0, 1), (1, 2): (0.0, 2), (2, 1): (0.0, 2), (2, 2): (1.0, 1)}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert retrieval.bm25_search(none, none.withColumnRenamed("doc_id", "item_id"), ("doc_id", "text"), ("item_id", "text")).count() == 0


def test_bpe_round_trip_and_ties(spark):
    merges = lm.train_bpe([("abab", 3), ("abc", 2)], 3)
    assert merges[0] == ("a", "b")
    rows = spark.createDataFrame([(1, "abab abc abab"), (2, None)], "id int, t string")
    out = {r.id: r.tokens for r in lm.bpe_encode(rows, "id", "t", merges).collect()}
    assert "".join(out[1]).replace("</w>", " ").strip() == "abab abc abab"
    vocab = lm.char_vocab(rows, "t")
    ids = lm.char_encode(rows.filter("id = 1"), "id", "t", vocab)
    assert lm.char_decode(ids, "id", "ids", vocab).first().text == "abab abc abab"


def test_splits_cover_and_are_disjoint(spark):
    for n in (1, 2, 3, 10, 25):
        rows = quality.splits(spark.range(n).withColumnRenamed("id", "doc_id"), "doc_id").collect()
        count = {s: sum(r.split == s for r in rows) for s in ("train", "validation", "test")}
        assert len(rows) == n and count["train"] >= 1 and (n < 3 or min(count.values()) >= 1)


def test_dates_prefer_what_follows(spark):
    got = lambda s, a: spark.createDataFrame([(s,)], "s string").select(extract.dates(F.col("s"), F.lit(a)).alias("d")).first().d
    assert got("In 1901 it was built and in 1920 it fell", 16).date_original == "1920"
    assert got("In 1901 and 1905 it was built", 25).date_original == "1905"
    d = got("It opened around 1880", 0)
    assert d.date_original == "around 1880" and d.normalised_date is None and d.note
    assert got("no date", 0).date_original is None


def test_conflicts_need_two_sources_and_dispute(spark):
    docs = spark.createDataFrame([("d1", "s1", "Grand Hotel", "u"), ("d2", "s2", "Grand Hotel", "u")], "document_id string, source_id string, title string, source_url string")
    say = "It is disputed but the Grand Hotel was constructed in {} on this hill."
    passages = spark.createDataFrame([("p1", "d1", 0, say.format(1880)), ("p2", "d2", 0, say.format(1890))], "passage_id string, document_id string, passage_index int, text string")
    found = extract.entities(docs, passages)
    events = extract.events(passages, found)
    relations, merged = extract.relations(passages, found)
    rows = extract.claims(events, relations, merged, passages, docs).collect()
    assert len(rows) == 2 and len({r.conflict_group for r in rows}) == 1 and rows[0].conflict_group and all(r.valid for r in rows)


def test_fetching_retries_and_reports(spark):
    class Flaky(collect.Fetcher):
        def fetch(self, url):
            if "bad" in url:
                raise OSError("down")
            return 200, b"x" * 200, "text/html"

    s = spark.createDataFrame([("a", "http://h/ok"), ("b", "http://h/bad")], "source_id string, url string")
    got = {r.source_id: (r.http_status, r.error) for r in collect.fetched(s, Flaky(), sleep=0.0).collect()}
    assert got == {"a": (200, None), "b": (None, "down")}
    rules = collect.robots_rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /bad\n")], "host string, body string"))
    assert {r.source_id: r.allowed for r in collect.robots_allowed(s, rules).collect()} == {"a": True, "b": False}


def test_streaming_ingest_is_incremental(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = lambda *ids: spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in ids], "page_id long, url string, html string")
    rows(1, 2).write.parquet(src)
    ingest.run_available(spark, src, out, check)
    rows(2, 3).write.mode("append").parquet(src)
    ingest.run_available(spark, src, out, check)
    assert sorted(r.page_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_artifacts_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b"), (2, None), (3, "b c")], "doc_id long, text string")
    index = retrieval.bm25_index(docs, "doc_id", "text")
    artifacts.save_index(index, str(tmp_path / "index"))
    loaded = artifacts.load_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, loaded.postings.select("id", "term", "tf").collect())) == sorted(map(tuple, index.postings.select("id", "term", "tf").collect()))
    sign = lambda df, d=64: artifacts.content_signature(df, "doc_id", "text", d).first().signature
    assert sign(docs) == sign(docs.repartition(3)) != sign(docs, 32) and sign(docs) != sign(docs.filter("doc_id < 3"))
    artifacts.save_tokenizer(spark, str(tmp_path / "tok"), "bpe", {"a": 4, "é": 5}, [("a", "b")])
    assert artifacts.load_tokenizer(spark, str(tmp_path / "tok"), "bpe") == ({"a": 4, "é": 5}, [("a", "b")])
    with pytest.raises(ValueError):
        artifacts.load_tokenizer(spark, str(tmp_path / "tok"), "char")
    for k in range(2):
        artifacts.append_log(spark, str(tmp_path / "log"), {"run": k})
    assert spark.read.text(str(tmp_path / "log")).count() == 2


def test_markdown_is_stripped_over_whole_texts(spark, tmp_path):
    from lorespark.plans import text_queries

    rows = [(1, "x" * 40 + " [far](http://far) end\n\n**second** ![i](u) line"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n): r.line for r in text_queries.stripped_markdown(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): "Note link " + "x" * 40 + " far end code", (1, 1): "Note link code", (1, 2): "Note link second line code", (2, None): None}


def test_bpe_learns_from_documents(spark, tmp_path):
    from lorespark.plans import corpus_queries

    spark.createDataFrame([(1, "zqzq zqzq zq"), (2, " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}xy" for k in range(600))), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    merges = [(r["left"], r["right"]) for r in corpus_queries.bpe_train(spark, str(tmp_path)).orderBy("rank").collect()]
    assert ("z", "q") in merges and ("x", "y") in merges and ("o", "t") not in merges and len(merges) > 200
    sizes = {r.doc_id: r.n_tokens for r in corpus_queries.bpe_encode(spark, str(tmp_path)).collect()}
    assert sizes[1] == 3
