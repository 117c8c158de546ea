"""Ids of word pieces, encoders as plug-ins, raw records as a table."""

import numpy as np
import pytest

from lorespark.operators import encoders, lm
from lorespark.sources import collect


def test_bpe_ids_and_back(spark):
    rows = spark.createDataFrame([(1, "abab abc, abab"), (2, "abz"), (3, ""), (4, None)], "id int, t string")
    known = rows.filter("id = 1")
    merges = lm.train_bpe([("abab", 3), ("abc", 2)], 2)
    vocab = lm.bpe_vocab(lm.word_freqs(known, "t"), merges)
    assert vocab.orderBy("id").first().id == len(lm.SPECIAL)
    assert vocab.count() == vocab.select("token").distinct().count()
    tokens = lm.bpe_encode(rows, "id", "t", merges)
    plain = {r.id: r.ids for r in lm.bpe_ids(tokens, "id", vocab).collect()}
    special = {r.id: r.ids for r in lm.bpe_ids(tokens, "id", vocab, special=True).collect()}
    assert 1 in plain[2] and all(special[k] == [2, *plain[k], 3] for k in plain)
    text = {r.id: r.text for r in lm.bpe_decode(lm.bpe_ids(tokens, "id", vocab, special=True), "id", "ids", vocab).collect()}
    assert text[1] == "abab abc , abab" and text[2] == "ab?"  # pieces are words and single marks, each with a space behind


def _letters():
    return lambda texts: np.array([[t.count("a"), t.count("b")] for t in texts], dtype=float)


def test_encoder_plug_in(spark):
    rows = spark.createDataFrame([(1, "aaa"), (2, "ab"), (3, None), (4, "")], "id long, t string")
    got = {r.id: r.vector for r in encoders.encoded(rows, "id", "t", encoders.FunctionEncoder(2, _letters, "b")).collect()}
    assert got[1] == [1.0, 0.0] and got[2] == pytest.approx([0.5**0.5] * 2) and got[3] == got[4] == [0.0, 0.0]
    asked = {r.id: r.vector for r in encoders.encoded(rows, "id", "t", encoders.FunctionEncoder(2, _letters, "b"), queries=True).collect()}
    assert asked[4] == [0.0, 1.0]
    with pytest.raises(Exception, match="encoder gave"):
        encoders.encoded(rows, "id", "t", encoders.FunctionEncoder(3, _letters)).collect()
    assert encoders.encoded(rows.limit(0), "id", "t", encoders.FunctionEncoder(2, _letters)).count() == 0


def test_raw_records_as_a_table(spark, tmp_path):
    for kind, ext, text in (("html", "html", "<p>a"), ("markdown", "md", "a"), ("metadata", "json", "{}")):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / f"s1.{ext}").write_text(text)
    (tmp_path / "html" / "s2.html").write_text("<p>b")
    records = collect.raw_records(spark, str(tmp_path))
    assert collect.count_violations(records.filter("source_id = 's1'"), 1).count() == 0
    assert collect.count_violations(records, 2).count() == 1
    collect.save_raw(records, str(tmp_path / "bronze"))
    got = {r.source_id: (bytes(r.html), r.markdown, r.metadata) for r in spark.read.parquet(str(tmp_path / "bronze")).collect()}
    assert got == {"s1": (b"<p>a", "a", "{}"), "s2": (b"<p>b", None, None)}
