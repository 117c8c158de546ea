"""Classifier, language ID, mixing, packing, licences, URL filter and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorespark.llm import langid, licenses, mixing, packing, quality, url_filter
from lorespark.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF
from ..oracle import assert_same
from .common import awkward, frame, sentence


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert_same(QUERIES[name], ORACLE_SQL[name], spark, SF)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op5_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    assert rows.predicted[rows.y == 1].mean() > 0.97 and rows.predicted[rows.y == 0].mean() < 0.2
    assert got.filter("held_out != (crc32(cast(cast(doc_id as string) as binary)) % 4 = 2)").count() == 0


def test_quality_edges(spark):
    labels = spark.createDataFrame([(None, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(frame(spark), quality.learn(frame(spark), labels)).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    assert quality.learn(frame(spark), labels.filter("false")).weights is None
    assert quality.scored(frame(spark, []), quality.learn(frame(spark, []), labels)).count() == 0


def test_prior_is_near_the_truth():
    rng = np.random.default_rng(0)
    p = np.hstack([rng.normal(1, 1, (4000, 2)), np.ones((4000, 1))])
    u = np.hstack([np.vstack([rng.normal(1, 1, (2400, 2)), rng.normal(-4, 1, (1600, 2))]), np.ones((4000, 1))])
    assert abs(quality.estimate_prior(p, rng.permutation(u)) - 0.6) < 0.07


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = langid.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.97 and rows.score.between(0, 1).all()


def test_language_edges(spark):
    model = langid.learn(frame(spark))
    rows = langid.identified(frame(spark), model).collect()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert {r.lang_pred for r in langid.identified(frame(spark), langid.learn(frame(spark, []))).collect()} == {"und"}


def test_mixing_targets_and_caps(spark):
    rows = mixing.copies(frame(spark)).collect()
    assert len(rows) == len(awkward())
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r.copies * r.size <= 3 * r.size
        p = per[r.source]
        p[0] += r.size
        p[1] += r.copies * r.size
        p[2] = r.target
    total = sum(p[0] for p in per.values())
    assert abs(sum(p[2] for p in per.values()) - total) < 1e-6 * total
    assert all(p[2] <= 3 * p[0] + 1e-6 for p in per.values())
    out = mixing.mixed(frame(spark))
    assert out.columns == frame(spark).columns and out.count() == sum(r.copies for r in rows)
    assert mixing.copies(frame(spark, [])).count() == 0


def test_mixing_fills_past_a_long_document(spark):
    first = min(range(1000), key=lambda k: hashlib.sha256(str(k).encode()).hexdigest())
    rows = [(k, "w " * (5000 if k == first else 10), "a") for k in range(1000)] + [(k, "w " * 6, ("b", "c")[k % 2]) for k in range(2000, 4000)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "abc":
        of = [r for r in got if r.source == source]
        left = of[0].target - sum(r.copies * r.size for r in of)
        whole = min(r.copies for r in of)
        assert -1e-3 <= left and not any(r.copies == whole and r.size <= left for r in of)


def mixed_by_hand(rows):
    """Copies of (doc_id, text, source) rows: the dual by bisection, then rounding one document at a time."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sha = [hashlib.sha256(("" if i is None else str(i)).encode()).hexdigest() for i, _, _ in rows]
    sources = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    own = {x: sum(n for n, r in zip(size, rows, strict=True) if r[2] == x) for x in sources}
    weight, full = {x: k % 3 + 1 for k, x in enumerate(sources)}, set()
    while True:
        rest, open_ = sum(own.values()) - sum(3 * own[x] for x in full), [x for x in sources if x not in full]
        target = {x: rest * weight[x] / sum(weight[y] for y in open_) for x in open_} | {x: 3 * own[x] for x in full}
        if not (more := [x for x in open_ if target[x] >= 3 * own[x]]):
            break
        full.update(more)
    out = [0] * len(rows)
    for x in sources:
        at = [k for k, r in enumerate(rows) if r[2] == x and size[k]]
        if not at:
            continue
        mean = own[x] / len(at)
        rates = lambda lam: [min(3.0, math.exp(min(lam * size[k] / mean, 2))) for k in at]  # noqa: E731, B023
        low, high = -60.0 * mean, 2.0 * mean
        for _ in range(300):
            lam = (low + high) / 2
            low, high = (lam, high) if sum(r * size[k] for r, k in zip(rates(lam), at, strict=True)) < target[x] else (low, lam)
        r = rates(high if x in full else lam)
        for k, v in zip(at, r, strict=True):
            out[k] = math.floor(v + 1e-9)
        left = target[x] - sum(out[k] * size[k] for k in at) + 1e-6
        order = sorted((int(sha[k][:13], 16) / 2**52 / max(v - out[k], 1e-9), sha[k], size[k], k) for k, v in zip(at, r, strict=True) if out[k] < 3)
        while order := [o for o in order if o[2] <= left]:
            take = []
            for o in order:
                if o[2] > left:
                    break
                take.append(o)
                left -= o[2]
            order = [o for o in order if o not in take]
            if fit := [o for o in order if o[2] <= left]:
                best = max(fit, key=lambda o: (o[2], o[1], o[3]))
                take.append(best)
                order.remove(best)
                left -= best[2]
            for o in take:
                out[o[3]] += 1
    return size, target, out


@pytest.mark.parametrize("which", ["whole table", "awkward", "one long document"])
def test_mixing_by_hand(spark, which):
    if which == "whole table":
        rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    elif which == "awkward":
        rows = [(k, r[1], r[3]) for k, r in enumerate(awkward())]
    else:
        rows = [(k, "w " * (5000 if k == 7 else 1 + k % 19), "abc"[k % 3]) for k in range(900)]
    size, target, want = mixed_by_hand(rows)
    got = {r.doc_id: r for r in mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[r[0]].size for r in rows] == size
    assert all(abs(got[r[0]].target - target[r[2]]) < 1e-6 * max(1, target[r[2]]) for r in rows)
    assert [got[r[0]].copies for r in rows] == want


def test_newton_meets_the_targets_with_tilted_rates(spark):
    rows = spark.createDataFrame([(k, "w " * (1 + k * k % 300), "abcd"[k % 4 if k % 7 else 0]) for k in range(2000)], "doc_id long, text string, source string")
    got = mixing.copies(rows).toPandas()
    for _, g in got.groupby("source"):
        assert abs((g["rate"] * g["size"]).sum() - g["target"].iloc[0]) < 1e-6 * g["target"].iloc[0]
        inside = g[(g["rate"] < 3) & (g["size"] > 0)]
        lam = np.log(inside["rate"]) / inside["size"]
        assert lam.max() - lam.min() < 1e-9 and inside["rate"].nunique() > 20  # tilted by size, not one rate for all
        assert (g["copies"] - g["rate"]).abs().max() < 1 + 1e-9 or (g["copies"] <= 3).all()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = awkward() + [(90, "l'été’s ½ don't <|endoftext|> Ǆ Σας 日本", None, None, 1, "", 0, 0, "", "", 0)]
    got = packing.pack(frame(spark, rows)).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r[0], k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()), len(ids)) for k in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    ends = defaultdict(list)
    for r in got:
        ends[r.sequence_id].append((r.offset, r.length))
    for x in ends.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 2048
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_of_each_character():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, words = Tokenizer.from_file(path), packing.WordEncoder(path)
    for c in map(chr, [*range(0x300), *range(0x2000, 0x2070), 0x1E9E, 0x212A, 0x212B]):
        text = f"A{c}b {c}{c} 1{c}'s !{c}? x'{c}S"
        assert words.encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), hex(ord(c))


def test_packing_needs_no_tokenizer_for_words():
    words = packing.WordEncoder(packing.default_tokenizer())
    text = "Don't cut l'été ½ – it's 42\x00\xad¡!"
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    words.tokenizer = None  # its normaliser and pre-tokenizer cost most of a new word's time
    assert words.encode(text) == np.array(want, "<u4").tobytes()


def test_patterns_use_the_histogram():
    rng = np.random.default_rng(2)
    histogram = {int(k): int(n) for k, n in zip(rng.choice(2048, 700, replace=False) + 1, rng.integers(1, 50, 700), strict=True)}
    packs = packing.patterns(histogram)
    used = Counter()
    for count, held in packs:
        assert sum(held) <= 2048
        for x in held:
            used[x] += count
    assert used == Counter(histogram)


WORD = re.compile(licenses.WORD)


def test_licenses(spark):
    rows = [(r[0], r[1]) for r in awkward()] + [
        (80, "Intro. Licensed under the Apache License, Version 2.0. " * 3), (81, "This work is licensed under the GNU General Public License, version 3."), (82, "the apache tribe had no license version"), (83, "cc by\tCC-BY ccby cc. by"), (84, "RELEASED under the MIT license"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([r for r in rows if r[0] is not None and r[0] != 3], "doc_id long, text string")).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        if i in got:
            words = WORD.findall((text or "").translate(low))
            places = [k for p in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
            assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
    assert got[80].labels == "apache-2.0" and got[81].labels == "gpl,gpl-3.0" and got[81].base_labels == "gpl" and got[82].labels == "" and got[84].labels == "mit" and got[83].n_base == 3
    assert licenses.scan(frame(spark)).count() == len(awkward()) and licenses.scan(frame(spark, [])).count() == 0


def labels_by_hand(words, rarest):
    """The method's labels of a file's words: starts on which enough of a template's rarest words agree, then its phrases."""
    out = set()
    for t, keys in zip(licenses.TEMPLATES, rarest, strict=True):
        own = t.text.split()
        votes = Counter(at - place for at, w in enumerate(words) if w in keys for place, x in enumerate(own) if x == w)
        for start, n in votes.items():
            low = max(0, start - licenses.SLACK)
            region = " " + " ".join(words[low : low + len(own) + 2 * licenses.SLACK]) + " "
            if n >= min(licenses.VOTES, len(keys)) and all(f" {p} " in region for p in t.phrases):
                out.add(t.label)
    return out


def test_licence_labels_by_hand(spark):
    rng = np.random.default_rng(3)
    texts = [t.text for t in licenses.TEMPLATES] + [licenses.TEMPLATES[0].text.upper() + "!", "cc by nc 4 0", "under the mit license released"]
    for k in range(150):
        words = []
        for _ in range(rng.integers(1, 5)):
            notice = licenses.TEMPLATES[rng.integers(len(licenses.TEMPLATES))].text.split()
            if rng.random() < 0.5:
                notice[rng.integers(len(notice))] = "other"
            if rng.random() < 0.3:
                notice.insert(rng.integers(len(notice)), "more")
            words += [*sentence(int(rng.integers(99)), int(rng.integers(0, 9))).split(), *notice]
        texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(None, None)]
    files = [WORD.findall((t or "").lower()) for _, t in rows]
    df = Counter(w for f in files for w in set(f))
    ranked = sorted(licenses.vocabulary(), key=lambda w: (df[w], w))
    rarest = [[w for w in ranked if w in t.text.split()][: licenses.KEYS] for t in licenses.TEMPLATES]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), words in zip(rows, files, strict=True):
        base = {v for p, v in licenses.BASE.items() if f" {p} " in f" {' '.join(words)} "}
        assert got[i].labels == ",".join(sorted(labels_by_hand(words, rarest) | base)), words


def test_no_licence_is_crowded_out(spark):
    notices = "\n".join(f"{k}. {t.text}." for k, t in enumerate(licenses.TEMPLATES))
    prose = "The person in charge kept a copy of the forms, in binary or as a source, on the subject of the terms of redistribution and permission, hereby granted. "
    filler = [(k, w) for k, w in enumerate(["released under the mit license", "licensed under the apache license version 2 0"] * 20, 10)]
    rows = [(1, notices), (2, prose * 3 + "This file was released under the MIT license. " + prose * 3), *filler]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got[1].split(",")) == {t.label for t in licenses.TEMPLATES} | {"gpl"} | ({"cc-by"} if "cc by" in notices else set())
    assert "mit" in got[2].split(",")


def test_url_filter_intervals(spark):
    entries = spark.createDataFrame([("a.com", 10, "block"), ("a.com", 20, "allow"), ("a.com", 15, "block"), ("x.a.com", 12, "allow"), ("a.com/p/", 12, "block"), ("t.com", 5, "allow"), ("t.com", 5, "block"), (None, 1, "block"), ("n.com", None, "block")], "pattern string, since long, action string")
    captures = spark.createDataFrame([(1, "http://a.com/", 9), (2, "http://a.com/", 10), (3, "http://A.com/p/q", 19), (4, "https://x.a.com/p/", 30), (5, "http://a.com/p/q", 25), (6, "http://t.com", 5), (7, None, 5), (8, "http://t.com", None), (2, "http://a.com/", 10), (9, "notaurl", 1)], "page_id long, url string, fetched_at long")
    got = Counter((r.page_id, r.action, r.n_active) for r in url_filter.filtered(captures, entries).collect())
    assert got == Counter([(1, "none", 0), (2, "block", 1), (2, "block", 1), (3, "block", 2), (4, "allow", 2), (5, "block", 2), (6, "block", 1), (7, "none", 0), (8, "none", 0), (9, "none", 0)])
    assert url_filter.filtered(captures.filter("false"), entries).count() == 0
    assert {r.action for r in url_filter.filtered(captures, entries.filter("false")).collect()} == {"none"}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    exact = corpus_pipeline.exact_stage(spark, kept, SF)
    near = corpus_pipeline.near_stage(spark, exact, SF)
    assert kept.columns == exact.columns == near.columns == docs.columns
    low = lambda df: {r.text.lower() for r in df.collect()}
    assert low(kept) == low(exact) and exact.count() == len(low(exact)) >= near.count() > 0
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "source mixing", "packing"]


def test_pipeline_edges(spark, tmp_path):
    for name, rows in (("awkward", awkward()), ("none", [])):
        frame(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (10, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet").select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES[1:]:
            assert stage(spark, docs, f"{tmp_path}/{name}").count() >= (len(rows) > 0)
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() >= 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_hosts(spark):
    rows = spark.createDataFrame([("http://u:p@a.com:80/x/",), ("https://a.com./x/y",), ("http://[::1]:8080/",), ("http://u@b.a.com",)], "url string")
    assert [r.host for r in url_filter.with_keys(rows).collect()] == ["a.com", "a.com", "[::1]", "b.a.com"]


def test_prediction_column_stays(spark):
    docs = spark.createDataFrame([(1, "some text", 5)], "doc_id long, text string, prediction int")
    row = langid.identified(docs, langid.learn(frame(spark))).first()
    assert row.prediction == 5 and row.lang_pred


def test_sentences_differ():
    assert len({sentence(k) for k in range(30)}) == 30
