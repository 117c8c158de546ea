"""Suffix dedup, exact dedup, near-duplicates and fingerprints against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.llm import exact_dedup, imatch, ngram_join, suffix_dedup, words
from lorespark.llm.components import components
from lorespark.llm.fuse import FuseFilter

from ..conftest import SF
from ..oracle import assert_same
from .common import awkward, frame, sentence


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=30), st.integers(0, 40))
def test_deep_shallow_sorts(strings, shared):
    strings = [b"\x01" * shared + s for s in strings]
    order, lcps = suffix_dedup.deep_shallow(strings)
    got = [strings[k] for k in order]
    assert got == sorted(strings) and sorted(order) == list(range(len(strings)))
    assert all(lcps[k] == suffix_dedup.common_prefix(got[k - 1], got[k]) for k in range(1, len(got)))


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=3000))
def test_fuse_has_no_false_negatives(keys):
    f = FuseFilter.build(np.array(sorted(keys), np.uint64))
    assert f.contains(np.array(sorted(keys), np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64)
    assert f.contains(others).mean() < 0.03


def repeated(texts):
    n, seen = suffix_dedup.LENGTH, Counter()
    for t in texts:
        seen.update(t[i : i + n] for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def suffix_rows():
    shared = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(900))
    rows = [(k, sentence(k, 20) + shared[k * 13 % 300 : 620 + k * 37 % 280] + sentence(k + 50, 20)) for k in range(25)]
    rows += [(40 + k, sentence(k + 90, 10) + "abcdefghi" * (30 + 11 * k) + sentence(k + 70, 10)) for k in range(12)]
    return rows + [(60, "z" * 5000), (61, "z" * 399), (62, "z" * 401), (63, "é" * 450)] + [(r[0], r[1]) for r in awkward()]


def test_suffix_dedup_against_brute_force(spark, monkeypatch):
    rows = suffix_rows()
    want = Counter((r[0], *x) for r, x in zip(rows, repeated([(r[1] or "").encode() for r in rows]), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "documents", lambda s, d: df)
    whole = suffix_dedup.repeated_spans
    for group in (suffix_dedup.GROUP, 3):  # with 3, most windows go the way of very large groups
        monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda s, d, g=group: whole(s, d, g))
        got = suffix_dedup.op1_suffix_dedup(spark, "")
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def shared_words(texts):
    n, words, seen = suffix_dedup.PASSAGE, [re.findall(rb"[^\t-\r ]+", t) for t in texts], {}
    for k, w in enumerate(words):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for w in words:
        held = set()
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i : i + n])]) > 1:
                held.update(range(i, i + n))
        out.append(len(held))
    return out


def passage_rows():
    passage = " ".join(f"w{k * k % 97}x{k}" for k in range(130))
    cut = lambda a, n: " ".join(passage.split()[a : a + n])
    rows = [(k, f"{sentence(k, 25)}\n{cut(k * 3 % 60, 49 + k % 12)}\t {sentence(k + 40, 30)}") for k in range(30)]
    rows += [(40, f"{cut(0, 60)} {cut(0, 60)}"), (41, "only " * 300), (42, "only " * 300 + "end"), (43, sentence(7, 55) * 2), (44, sentence(8, 120)), (45, sentence(8, 120)), (46, "a " * 49), (47, "a " * 49 + "a"), (48, "b " * 50)]
    return rows + [(r[0], r[1]) for r in awkward()]


def test_passages_against_brute_force(spark, monkeypatch):
    rows = passage_rows()
    want = Counter((r[0], n) for r, n in zip(rows, shared_words([(r[1] or "").encode() for r in rows]), strict=True))
    assert 10 < sum(n > 0 for _, n in want) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "documents", lambda s, d: df)
    whole = suffix_dedup.repeated_spans
    for group in (suffix_dedup.GROUP, 3):
        monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda s, d, g=group: whole(s, d, g))
        assert Counter((r.doc_id, r.n_shared_words) for r in suffix_dedup.op1_suffix_dedup(spark, "").collect()) == want


def test_parts_of_a_text_meet(monkeypatch):
    text = " ".join(f"word{k % 611}é{k}" for k in range(4000)).encode() + b" " + b"y" * 3000
    codes, places = suffix_dedup.passage_codes(text), suffix_dedup.anchors(text)
    found = suffix_dedup.word_anchors(codes)
    monkeypatch.setattr(suffix_dedup, "PART", 5000)
    monkeypatch.setattr(words, "PART", 5000)
    assert (suffix_dedup.passage_codes(text) == codes).all() and suffix_dedup.anchors(text) == places
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    assert suffix_dedup.word_anchors(codes) == found


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffix_dedup.repeated_spans(spark, none)[0].count() == 0
    assert exact_dedup.exact_dedup(spark, none).count() == 0
    assert ngram_join.near_classes(spark, none).count() == 0
    assert imatch.fingerprints(spark, none).count() == 0


def test_exact_dedup_on_awkward_rows(spark):
    rows = awkward()
    low = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    size = Counter(low(r[1]) for r in rows)
    got = exact_dedup.exact_dedup(spark, frame(spark)).collect()
    best = {}
    for r in rows:
        best[low(r[1])] = max(best.get(low(r[1]), -1), -1 if r[0] is None else r[0])
    want = Counter((r[0], None if best[low(r[1])] < 0 else best[low(r[1])], size[low(r[1])]) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(size)
    kept = exact_dedup.kept_rows(spark, frame(spark))
    assert kept.columns == frame(spark).columns and kept.count() == len(size)


def test_large_batch_on_a_small_snapshot(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 40)
    docs = spark.createDataFrame([(k, f"text {k % 700}") for k in range(1000)], "doc_id long, text string")
    for sent in (True, False):  # with and without the filter that spares a shuffle
        if not sent:
            monkeypatch.setattr(exact_dedup, "sent_filter", lambda *_: None)
        for batch in (F.col("doc_id") >= 10, F.col("doc_id") >= 990, F.col("doc_id") < 0, F.col("doc_id") >= 0):
            got = exact_dedup.exact_dedup(spark, docs, is_new=batch).collect()
            assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter((k, 700 + k % 700 if k % 700 < 300 else k, 1 + (k % 700 < 300), k >= 300) for k in range(1000))


def test_exact_dedup_matches_sql(spark):
    assert_same(exact_dedup.op4_exact_dedup, exact_dedup.ORACLE, spark, SF)


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_brute(rows):
    sets = [shingles(t) for _, t in rows]
    links, group = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both, any_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= 0.8 * any_:
                links[i] += 1
                links[j] += 1
                group[root(i)] = root(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    return Counter((i, min([x for x in ids[root(k)] if x is not None], default=None), links[k]) for k, (i, _) in enumerate(rows))


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    base = sentence(5, 200).split()
    edits = []
    for k in range(40):
        w = list(base)
        w[5 * k % 190] = f"new{k}"
        if k % 3 == 0:
            w[(5 * k + 60) % 190] = f"more{k}"
        edits.append((200 + k, " ".join(w)))
    rows = [(r[0], r[1]) for r in awkward()] + edits + edits[:5] + [(300 + k, sentence(k, 80)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_brute(rows)
    for block in (500, 7):  # with 7, groups are compared block against block
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = ngram_join.near_classes(spark, df)
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == want
    kept = ngram_join.representatives(spark, frame(spark))
    assert kept.columns == frame(spark).columns


def test_prefixes_are_shortened_to_the_recall():
    symbols = ngram_join.TREES * ngram_join.LONGEST
    close, near = {symbols: 5000}, {round(symbols * 0.82): 5000}
    lengths = [ngram_join.prefix_length(x) for x in (close, {**close, **near}, near, {})]
    assert ngram_join.LONGEST >= lengths[0] > lengths[1] >= lengths[2] >= lengths[3] == 7
    assert ngram_join.found_at(np.array(0.8), 7) >= ngram_join.RECALL > ngram_join.found_at(np.array(0.8), 8)
    assert ngram_join.found_at(np.array(0.8), ngram_join.SHORTEST) > 1 - 1e-5


def test_ties_are_neighbours_in_the_sorted_tries(spark):
    rng = np.random.default_rng(4)
    signs = rng.integers(0, 3, (300, ngram_join.TREES, ngram_join.LONGEST)).astype(np.uint8) + 126  # across the sign bit
    rows = [(k, x[:, :8].copy().view(">i8").ravel().tolist(), x[:, 8:].copy().view(">i4").ravel().tolist()) for k, x in enumerate(signs)]
    got = Counter((r.lcp, frozenset((r.a, r.b))) for r in ngram_join.ties(spark.createDataFrame(rows, "uid long, high array<long>, low array<int>").repartition(3)).collect())
    for length in (5, 6, 8):  # a node's sets are tied to each other, and to no others
        for tree in (0, 17):
            nodes = {}
            for k, x in enumerate(signs):
                nodes.setdefault(x[tree, :length].tobytes(), []).append(k)
            want = sum(len(x) - 1 for x in nodes.values())
            inside = {frozenset((a, b)) for x in nodes.values() for a in x for b in x if a < b}
            assert sum(n for (lcp, pair), n in got.items() if lcp >= length and pair in inside) >= want
    total = sum(len({x[t, :5].tobytes() for x in signs}) for t in range(ngram_join.TREES))
    assert sum(got.values()) == 300 * ngram_join.TREES - total


def test_recall_of_links_near_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(500):
        words = [f"{x}" for x in rng.integers(0, 3000, 150)]
        edited = list(words)
        for place in rng.choice(150, 1 + k % 4, replace=False):
            edited[place] = f"e{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    want = {(a[0], b[0]) for a, b in zip(rows[::2], rows[1::2], strict=True) if len(shingles(a[1]) & shingles(b[1])) >= 0.8 * len(shingles(a[1]) | shingles(b[1]))}
    got = {r.doc_id: r for r in ngram_join.near_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[a].class_id == got[b].class_id == a for a, b in want)
    assert 300 < len(want) < 450 and found >= 0.99 * len(want)
    assert sum(r.n_links for r in got.values()) == 2 * found


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 50)] + [(100, 160), (160, 130), (130, 101), (7, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 130: 100, 160: 100}


def test_imatch_edits_and_likeness(spark):
    rows = [(k, sentence(k, 120)) for k in range(40)] + [(50, sentence(3, 120)), (51, None), (52, ""), (53, "x y"), (None, "né 🎉 z")]
    got = imatch.fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    at = {r[0]: k for k, r in enumerate(order)}
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, text in rows:
        text, following = text or "", order[(at[i] + 1) % len(order)][1] or ""
        half = len(text) // 2
        assert by[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        assert by[i].n_chars == len(text) and 0 <= by[i].near_edited <= 1 and 0 <= by[i].near_next <= 1
    assert by[3].fingerprint == by[50].fingerprint and by[51].fingerprint == by[52].fingerprint
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got])


def imatch_by_hand(rows):
    """doc_id to (fingerprint, edited_fingerprint, near_edited, near_next) of rows (doc_id, text)."""
    xx = lambda data, seed: xxhash.xxh64_intdigest(data, seed & (2**64 - 1))
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    long = lambda v, seed: xx(v.to_bytes(8, "little", signed=True), seed)
    terms = lambda t: {signed(xx(w.encode(), 42)) for w in regex.findall(imatch.TERM, t.lower())}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    edited = [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]
    df = Counter(w for t in texts for w in terms(t))
    n = len(rows)
    words = {w for w, c in df.items() if n * math.exp(-imatch.HIGH_IDF) <= c <= n * math.exp(-imatch.LOW_IDF)}
    chosen = lambda w, k: signed(xx(k.to_bytes(4, "little"), long(w, 42))) % (1 << imatch.LEVELS[k]) == 0
    mask = {w: sum(1 << k for k in range(imatch.SUBSETS) if chosen(w, k)) for w in words}

    def hashes(text):
        kept = sorted(terms(text) & words)
        if not kept:
            code = signed(xx(text.encode(), 42))
            return [xx((-1 - k).to_bytes(4, "little", signed=True), long(code, 42)) for k in range(imatch.SUBSETS)]
        out = []
        for k in range(imatch.SUBSETS):
            h = 42
            for w in kept:
                if mask[w] >> k & 1:
                    h = long(mask[w], long(w, h))
            out.append(h)
        return out

    def near(a, b):
        both = [None if x == y == 42 else x == y for x, y in zip(a, b, strict=True)]
        thin = [x for x in both[imatch.LEVELS.index(imatch.THIN) :] if x is not None]
        used = thin if len(thin) >= imatch.LEAST_THIN else [x for x in both if x is not None]
        return float(a == b) if not used or a == b else sum(used) / len(used)

    a, b = [hashes(t) for t in texts], [hashes(t) for t in edited]
    text = lambda hs: "".join(f"{h:016x}" for h in hs)
    return {i: (text(a[k]), text(b[k]), near(a[k], b[k]), near(a[k], a[(k + 1) % n])) for k, (i, _) in enumerate(order)}


def test_imatch_by_hand(spark):
    rows = [(k, sentence(k, 20 + 7 * k)) for k in range(40)] + [(50, sentence(3, 41)), (51, None), (52, ""), (53, "x y"), (None, "né 🎉 z"), (60, "Ünïcode _a_ 12 ab " * 30)]
    got = imatch.fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert dict(got.dtypes)["fingerprint"] == dict(got.dtypes)["edited_fingerprint"] == "string"
    want = imatch_by_hand(rows)
    for r in got.collect():
        assert (r.fingerprint, r.edited_fingerprint) == want[r.doc_id][:2]
        assert abs(r.near_edited - want[r.doc_id][2]) < 1e-9 and abs(r.near_next - want[r.doc_id][3]) < 1e-9


def test_imatch_survives_awkward_rows(spark):
    assert imatch.fingerprints(spark, frame(spark)).count() == len(awkward())
