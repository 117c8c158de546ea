"""Removal of repeated byte strings with suffixes sorted deep-shallow.

Every string of LENGTH bytes that starts at two places at least is repeated, and its bytes go everywhere. Not
all suffixes are sorted: of every LENGTH bytes the place of the least hash among their windows of GRAM bytes is
an anchor, so equal strings have an anchor at the same offset, and suffixes at anchors suffice. An anchor's
context is what the strings that chose it span. Anchors whose window occurs once are dropped by count. The others meet by window: their suffixes, and the reversed bytes
before them, are each put in order by the deep-shallow method (Manzini and Ferragina, 2004): multikey quicksort
to a shallow depth, and blind tries for what is still equal there. From the orders with their common prefix
lengths follows how far each place agrees with any other to both sides.

Rows: a null text is an empty text; texts shorter than LENGTH bytes keep all; whole equal texts of LENGTH
bytes and more are removed in full (all of them, there is no first one); repeated rows count as other places;
a null doc_id is carried; ties don't matter, as all places of a string are treated alike; an empty table gives
no rows; columns other than doc_id and text are ignored.

Passages are found beside them in the same way, over words in place of bytes: strings of PASSAGE words that
another document holds too. They are counted (n_shared_words), not removed. A word is a run of other characters
than ASCII white space; one of over a megabyte counts as several.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, documents, freed, materialize, prepare
from .words import mix, powers, word_codes

LENGTH, GRAM = 400, 64
#: The same in words, and the bytes that stand for a word.
PASSAGE, WORD_GRAM, CODE = 50, 8, 4
#: What a row of anchors, contexts or spans is about; WORDS rows hold a text's number of words.
BYTES, PASSAGES, WORDS = 0, 1, 2
#: Multikey quicksort goes so deep, blind tries deeper.
SHALLOW = 24
#: Texts are searched for anchors in parts of this size.
PART = 1 << 20
#: Anchors of one window that a task takes; more of them are compared string by string in many tasks.
GROUP = 100_000

U = np.uint64
ODD = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(ODD, -1, 2**64)


_tables: list[np.ndarray] = []


def _window_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    if not _tables or len(_tables[0]) <= len(data):
        size = len(data) + (1 << 16)
        _tables[:] = powers(INVERSE, size), powers(ODD, size)
    down, up = _tables
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * down[: len(data)], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * up[: len(data) - GRAM + 1]
        h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
        return h ^ (h >> U(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, from running minima of blocks to both sides."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def passage_codes(text: bytes) -> np.ndarray:
    """A 32-bit code of each word."""
    return (word_codes(text) >> U(32)).astype("<u4")


def _word_windows(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the WORD_GRAM words from each place on."""
    n = len(codes) - WORD_GRAM + 1
    h = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for k in range(WORD_GRAM):
            h = mix(h * U(ODD) + codes[k : k + n].astype(U) + U(1))
    return h


def anchors(text: bytes) -> list[tuple[int, int, int, int, int]]:
    """(hash, place, first, last, high): the strings that start from first to last have their anchor at place.

    That is where the window hash is least among theirs (the leftmost, if equal). Within a periodic run,
    neighbours of equal contexts are equal strings over and over: one row stands for all, and high is the end
    of what they cover, else 0.
    """
    out: list[tuple[int, int, int, int, int]] = []
    for h, place, first, last in _chosen(len(text), lambda a, b: _window_hashes(np.frombuffer(text[a:b], np.uint8)), LENGTH, GRAM):
        if out:
            ph, pp, pf, pl, high = out[-1]
            if ph == h and place - first == pp - pf and last - first == pl - pf and text[first : last + LENGTH] == text[pf : pl + LENGTH] and first <= (high or pl + LENGTH):
                out[-1] = (ph, pp, pf, pl, last + LENGTH)
                continue
        out.append((h, place, first, last, 0))
    return out


def word_anchors(codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The same for strings of PASSAGE words, places in words; high is 0."""
    return [(*x, 0) for x in _chosen(len(codes), lambda a, b: _word_windows(codes[a:b]), PASSAGE, WORD_GRAM)]


def _chosen(n: int, hashes: Callable[[int, int], np.ndarray], length: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(hash, place, first, last) of each anchor of n bytes or words; hashes gives those of a part's windows."""
    width, mask = length - gram + 1, U(0x7FFFFF)
    out: list[tuple[int, int, int, int]] = []
    for start in range(0, max(0, n - length + 1), PART):
        h = hashes(start, start + PART + length - 1)
        at = (_sliding_min((h & ~mask) | np.arange(len(h), dtype=U), width) & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        at = at[first]
        found = zip(h[at].astype(np.int64).tolist(), (at + start).tolist(), (first + start).tolist(), (last + start).tolist(), strict=True)
        if out and (row := next(found, None)):
            if out[-1][:2] == row[:2]:  # a context that two parts share
                row = (*row[:2], min(out[-1][2], row[2]), max(out[-1][3], row[3]))
                out.pop()
            out.append(row)
        out += found
    return out


# ---------------------------------------------------------------- deep-shallow order


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - -(-x.bit_length() // 8)


def _blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """Order of the members, and the common prefix of each with the one before it (0 for the first).

    A node is [depth, children by byte]; a leaf is the list of equal strings. A string goes down by the bytes
    at branching depths alone, meets some leaf, and is compared with that leaf once to find its place.
    """
    def byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    first = strings[members[0]]
    root: list = [len(first), {-1: [members[0]]}]
    for m in members[1:]:
        s, node, path = strings[m], root, []
        while True:
            path.append(node)
            child = node[1].get(byte(s, node[0]))
            if child is None:
                child = next(iter(node[1].values()))
            if isinstance(child[0], int) and (len(child) == 1 or not isinstance(child[1], dict)):
                break
            node = child
        lcp = common_prefix(s, strings[child[0]])
        if lcp == len(s) == len(strings[child[0]]):
            child.append(m)
            continue
        above, below = None, root
        for node in path:
            if node[0] >= lcp:
                below = node
                break
            above, below = node, node[1].get(byte(s, node[0]))
        if below is not None and isinstance(below[0], int) and len(below) == 2 and isinstance(below[1], dict) and below[0] == lcp:
            below[1][byte(s, lcp)] = [m]
            continue
        other = strings[child[0]]
        new = [lcp, {byte(other, lcp): below, byte(s, lcp): [m]}]
        if above is None:
            root = new
        else:
            above[1][byte(s, above[0])] = new
    order, lcps = [], []
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if len(node) == 2 and isinstance(node[1], dict):
            for k, key in enumerate(sorted(node[1], reverse=True)):
                stack.append((node[1][key], depth if k == len(node[1]) - 1 else node[0]))
        else:
            for k, m in enumerate(node):
                order.append(m)
                lcps.append(depth if k == 0 else len(strings[m]))
    return order, lcps


def _multikey(strings: list[bytes], members: list[int], depth: int, out: list[tuple[list[int], int]]) -> None:
    """Three-way quicksort by the byte at depth; groups still equal at SHALLOW are left whole, with their depth."""
    work = [(members, depth)]
    while work:
        part, d = work.pop()
        if len(part) == 1 or d >= SHALLOW:
            out.append((part, d))
            continue
        keys = [strings[m][d] if d < len(strings[m]) else -1 for m in part]
        pivot = sorted(keys)[len(keys) // 2]
        same = [m for m, k in zip(part, keys, strict=True) if k == pivot]
        if len(same) == len(part):
            work.append((part, SHALLOW if pivot < 0 else d + 1))
            continue
        work.append(([m for m, k in zip(part, keys, strict=True) if k > pivot], d))
        work.append((same, SHALLOW if pivot < 0 else d + 1))
        work.append(([m for m, k in zip(part, keys, strict=True) if k < pivot], d))
        work = [(p, x) for p, x in work if p]


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and common prefix length of each with the one before it in that order."""
    groups: list[tuple[list[int], int]] = []
    _multikey(strings, list(range(len(strings))), 0, groups)
    order: list[int] = []
    lcps: list[int] = []
    for part, _ in groups:
        inner, inner_lcps = _blind_trie(strings, part)
        if order:
            inner_lcps[0] = common_prefix(strings[order[-1]], strings[inner[0]])
        order += inner
        lcps += inner_lcps
    return np.array(order), np.array(lcps)


def _covered(before: list[bytes], after: list[bytes], owner: list[int], kind: int = BYTES) -> list[tuple[int, int]]:
    """For each place the bytes to the left and right that repeated strings through it cover, or (0, 0).

    before holds the units before the place in reverse, and all of after begin with the same window. Two places
    of different owners that agree on l bytes to the left and r to the right repeat a string if l + r makes up
    its length, and then all l + r bytes are covered. Units of passages are words of CODE bytes.
    """
    length, gram, unit = (LENGTH, GRAM, 1) if kind == BYTES else (PASSAGE * CODE, WORD_GRAM * CODE, CODE)
    n = len(after)
    if n == 1:
        return [(0, 0)]
    if n == 2:
        l, r = (x - x % unit for x in (common_prefix(*before), common_prefix(*after)))
        return [(l, r)] * 2 if l + r >= length and owner[0] != owner[1] else [(0, 0)] * 2
    ranks, lcps = [], []
    for strings, known in ((before, 0), ([a[gram:] for a in after], gram)):
        order, lcp = deep_shallow(strings)
        lcp[1:] += known
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks.append(rank)
        lcps.append(lcp - lcp % unit)
    owners = np.array(owner, np.int64)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # A string with j bytes left of the anchor is repeated where two places are equal on j bytes to the left
    # and length - j to the right. Only j at which either order splits anew can change the classes.
    steps = np.unique(np.concatenate([[0, length - gram], lcps[0], lcps[0] + unit, length - lcps[1], length - lcps[1] - unit]))
    for j in steps[(steps >= 0) & (steps <= max(map(len, before)))]:
        l_class = np.cumsum(lcps[0] < j)[ranks[0]]
        r_class = np.cumsum(lcps[1] < length - j)[ranks[1]]
        classes, inverse = np.unique(l_class * (n + 1) + r_class, return_inverse=True)
        low, high = np.full(len(classes), np.iinfo(np.int64).max), np.full(len(classes), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, owners)
        np.maximum.at(high, inverse, owners)
        twice = (low != high)[inverse]
        left[twice] = np.maximum(left[twice], j)
        right[twice] = np.maximum(right[twice], length - j)
    return list(zip(left.tolist(), right.tolist(), strict=True))


# ---------------------------------------------------------------- tasks


ANCHOR = "kind int, h long, digest binary, place int, first int, last int, high int"
CONTEXT = "kind int, h long, m long, digest binary, place long, high long, before binary, after binary"
SPAN = "kind int, digest binary, low long, high long"
#: Rows a task hands on at a time.
ROWS = 4096


def _frames(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """Rows in frames of a bounded size."""
    columns, held = [x.split()[0] for x in schema.split(", ")], []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pd.DataFrame(held, columns=columns)
            held = []
    yield pd.DataFrame(held, columns=columns)


def _scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors of each text with its digest, and its number of words. A task's further copies of a text are skipped."""
    def rows() -> Iterator[tuple]:
        seen: set[bytes] = set()
        for part in parts:
            for digest, text in zip(part["digest"], part["text"], strict=True):
                if digest in seen:
                    continue
                seen.add(digest)
                codes = passage_codes(text)
                for kind, found in ((BYTES, anchors(text)), (PASSAGES, word_anchors(codes))):
                    yield from ((kind, h, digest, *place) for h, *place in found)
                if len(codes) >= PASSAGE:
                    yield WORDS, len(codes), digest, 0, 0, 0, 0

    return _frames(rows(), ANCHOR)


def _contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes, or codes of words, before (in reverse) and after each wanted anchor of each text."""
    def rows() -> Iterator[tuple]:
        for part in parts:
            for digest, packed, marks in zip(part["digest"], part["packed"], part["marks"], strict=True):
                text = zstandard.decompress(packed)
                codes = passage_codes(text) if any(a["kind"] == PASSAGES for a in marks) else None
                for a in marks:
                    p, first, end = a["place"], a["first"], a["last"]
                    if a["kind"] == BYTES:
                        before, after = text[first:p][::-1], text[p : end + LENGTH]
                    else:
                        before, after = codes[first:p][::-1].tobytes(), codes[p : end + PASSAGE].tobytes()
                    yield a["kind"], a["h"], a["m"], digest, p, a["high"], before, after

    return _frames(rows(), CONTEXT)


def _covered_by_group(before: list[bytes], after: list[bytes], digests: list[bytes], kind: int) -> list[tuple[int, int]]:
    """_covered, with equal contexts compared once: those of different owners repeat each other in full."""
    where: dict[tuple[bytes, bytes], list[int]] = {}
    for k, context in enumerate(zip(before, after, strict=True)):
        where.setdefault(context, []).append(k)
    full = [len(x) > 1 and (kind == BYTES or len({digests[k] for k in x}) > 1) for x in where.values()]
    numbers = {d: k for k, d in enumerate(set(digests))}
    # Every place owns itself for bytes, documents own theirs for passages; a context of several owners is one more.
    owner = [-1 - k if kind == BYTES or full[k] else numbers[digests[x[0]]] for k, x in enumerate(where.values())]
    out = [(0, 0)] * len(before)
    for (b, a), members, whole, found in zip(where, where.values(), full, _covered([x for x, _ in where], [x for _, x in where], owner, kind), strict=True):
        for k in members:
            out[k] = (len(b), len(a)) if whole else found
    return out


def _grouped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Covered spans around anchors that come sorted by kind and window hash."""
    def spans(held: list[tuple]) -> Iterator[tuple]:
        kind = held[0][0]
        for (_, _, digest, place, high, before, _), (l, r) in zip(held, _covered_by_group([x[5] for x in held], [x[6] for x in held], [x[2] for x in held], kind), strict=True):
            if kind == PASSAGES and r:
                yield kind, digest, place - l // CODE, place + r // CODE
            elif kind == BYTES and (high or r):
                yield kind, digest, place - (len(before) if high else l), max(high, place + r)

    def rows() -> Iterator[tuple]:
        held: list[tuple] = []
        for part in parts:
            for row in zip(part["kind"], part["h"], part["digest"], part["place"], part["high"], part["before"], part["after"], strict=True):
                if held and held[0][:2] != row[:2]:
                    yield from spans(held)
                    held = []
                held.append(row)
        if held:
            yield from spans(held)

    return _frames(rows(), SPAN)


def _strings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every string of each context as a 128-bit code, for windows of very many places."""
    def rows() -> Iterator[tuple]:
        for part in parts:
            for kind, digest, place, high, before, after in zip(part["kind"], part["digest"], part["place"], part["high"], part["before"], part["after"], strict=True):
                unit, length = (1, LENGTH) if kind == BYTES else (CODE, PASSAGE)
                near = np.frombuffer(before, np.uint8).reshape(-1, unit)[::-1].tobytes() + after
                low = place - len(before) // unit
                for k in range(len(near) // unit - length + 1):
                    yield hashlib.blake2b(near[k * unit : (k + length) * unit], digest_size=16).digest(), kind, digest, low + k, high

    return _frames(rows(), "code binary, " + SPAN)


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


REMOVED = "digest binary, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, runs array<struct<low:long,high:long>>"


def _removed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for part in parts:
            for digest, packed, spans in zip(part["digest"], part["packed"], part["spans"], strict=True):
                runs, passages = (_merged([s for s in spans if s["kind"] == kind]) for kind in (BYTES, PASSAGES))
                text, at, kept = zstandard.decompress(packed), 0, hashlib.sha256()
                for low, high in runs:
                    kept.update(text[at:low])
                    at = high
                kept.update(text[at:])
                size = lambda xs: sum(b - a for a, b in xs)
                yield digest, size(runs), len(runs), kept.hexdigest(), size(passages), [{"low": a, "high": b} for a, b in runs]

    return _frames(rows(), REMOVED)


def _packer() -> Callable:
    @F.pandas_udf("binary")
    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for part in texts:
            yield part.map(squeeze)

    return pack


def repeated_spans(spark: SparkSession, docs: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, sha, digest, n_bytes, copies, n_words), and by digest what is repeated: columns of REMOVED.

    copies counts the rows of a text; n_words is given where copies is above 1 and the text holds a passage.
    """
    prepare(spark)
    raw = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    raw = raw.withColumn("sha", F.sha2("text", 256)).withColumn("digest", F.substring(F.unhex("sha"), 1, 16))
    rows = materialize(raw.select("doc_id", "key", "sha", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    copies = materialize(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("key")), "copies")

    long_ = raw.filter(F.octet_length("text") >= min(LENGTH, 2 * PASSAGE - 1))
    scanned = materialize(long_.select("digest", "text").mapInPandas(lambda parts: freed(_scan(parts)), ANCHOR), "anchors")
    words = scanned.filter(F.col("kind") == WORDS).groupBy("digest").agg(F.max("h").alias("n_words"))
    found = scanned.filter(F.col("kind") != WORDS)
    # A window that only one place of one text has, in however many copies, is not repeated; nor is one of words in one text.
    where = F.when(F.col("kind") == BYTES, F.xxhash64("digest", "place")).otherwise(F.xxhash64("digest"))
    counts = found.groupBy("kind", "h").agg(F.count(F.lit(1)).alias("m"), F.min(where).alias("a"), F.max(where).alias("b"), F.max("high").alias("high")).filter("a <> b OR high > 0").select("kind", "h", "m")
    counts = materialize(counts, "windows")
    marks = found.join(counts, ["kind", "h"]).groupBy("digest").agg(F.collect_set(F.struct("kind", "h", "m", "place", "first", "last", "high")).alias("marks")).join(copies.select("digest", "key"), "digest")
    # The texts that hold such anchors, once each and compressed, are all that moves from here on.
    held = materialize(long_.select("key", "digest", _packer()("text").alias("packed")).join(marks, ["digest", "key"]).select("digest", "packed", "marks"), "marked-texts")

    near = held.mapInPandas(_contexts, CONTEXT)
    spans = near.filter(F.col("m") <= group).drop("m").repartition("kind", "h").sortWithinPartitions("kind", "h", "digest", "place").mapInPandas(lambda parts: freed(_grouped(parts)), SPAN)
    if not counts.filter(F.col("m") > group).isEmpty():
        strings = near.filter(F.col("m") > group).mapInPandas(_strings, "code binary, " + SPAN).distinct()
        owner = F.when(F.col("kind") == BYTES, F.xxhash64("digest", "low")).otherwise(F.xxhash64("digest"))
        twice = strings.groupBy("kind", "code").agg(F.min(owner).alias("a"), F.max(owner).alias("b")).filter("a <> b")
        length = F.when(F.col("kind") == BYTES, LENGTH).otherwise(PASSAGE)
        spans = spans.unionByName(strings.join(twice, ["kind", "code"], "left_semi").select("kind", "digest", "low", (F.col("low") + length).alias("high")))
        spans = spans.unionByName(strings.filter("high > 0").select("kind", "digest", "low", "high"))
    spans = materialize(spans, "spans").groupBy("digest").agg(F.collect_list(F.struct("kind", "low", "high")).alias("spans"))
    out = held.select("digest", "packed").join(spans, "digest").mapInPandas(lambda parts: freed(_removed(parts)), REMOVED)
    copies = copies.select("digest", "copies").join(words, "digest", "left").withColumn("n_words", F.when(F.col("copies") > 1, F.col("n_words")))
    return rows.join(copies, "digest"), out


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, gone = repeated_spans(spark, documents(spark, sf_dir))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.join(gone, "digest", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.coalesce("n_words", "n_shared_words", F.lit(0)).cast("long").alias("n_shared_words"),
    )
