"""N-gram Jaccard join by a MinHash LSH forest, with exact shingle sets to decide.

A document is the set of its five-word shingles; documents of equal sets collapse to one first. Every set has a
signature of LONGEST minima in each of TREES trees (Bawa et al., "LSH Forest", 2005). A tree is a sorted prefix trie
of its signatures: the sets are sorted by tree and signature over the whole cluster, so that sets under one node
are neighbours, and each set has with the one before it a longest matched prefix. Matched prefixes are shortened
from LONGEST down, in all trees at once, until the recall that follows from the similarities of the data at hand
reaches the target (see prefix_length). Sets with a common prefix of that length are tied along the sorted order,
ties join to candidate groups, and in every group all pairs are compared exactly, in blocks.

Words are runs of non-space, lower-cased; a text of fewer than five words is one shingle. Two documents are
linked if the Jaccard similarity of their sets is at least 0.8; a class is a connected component of links.

Rows: a null text is an empty text; texts without a word have equal, empty sets and are linked to each other
only; a repeated row is linked to its repeats; class_id is the least non-null doc_id of the class (null if it
has none); ties are none, as links and classes are sets; texts of any length are read whole; an empty table
gives no rows; columns other than doc_id and text are ignored, or kept by representatives().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, documents, freed, fresh, materialize, prepare, text_or_empty
from .components import components
from .screens import sent_filter
from .words import mix, word_codes

SHINGLE = 5
#: At least 4/5: intersections count 9 times against 4 times the sum of both sizes.
SIMILARITY = 0.8
#: Trees, symbols (of eight bits) of a signature in each, and the recall at which prefixes are short enough.
TREES, LONGEST, RECALL = 32, 12, 0.999
#: Shorter prefixes are never needed: sets at SIMILARITY share one of this length in some tree, but for 1 in 100,000.
SHORTEST = 5
#: Of all links, so many are taken to lie at SIMILARITY itself, beside those seen.
LEAST_SIMILAR = 0.05
#: Sets compared at a time and shingles in them; a larger candidate group is compared block against block.
BLOCK, BLOCK_SHINGLES = 500, 500_000
#: Distinct shingles held as matrix columns at a time.
COLUMNS = 4096

U = np.uint64
#: White space of Unicode beyond ASCII's, and control characters that part words.
SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_rng = np.random.default_rng(20)
_factors = _rng.integers(0, 2**32, TREES * LONGEST, dtype=U).astype(np.uint32)[None, :] | np.uint32(1)
_offsets = _rng.integers(0, 2**32, TREES * LONGEST, dtype=U).astype(np.uint32)[None, :]
_columns = np.arange(TREES * LONGEST, dtype=U)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingles of a whole text as 64-bit hashes."""
    text = (text or "").lower()
    codes = word_codes((text if text.isascii() and not SPACES.search(text) else SPACES.sub(" ", text)).encode("utf-8", "surrogatepass"))
    if not len(codes):
        return codes
    span = min(SHINGLE, len(codes))
    with np.errstate(over="ignore"):
        h = np.full(len(codes) - span + 1, span, U)
        for k in range(span):
            h = mix(h + codes[k : len(codes) - span + 1 + k])
    return np.unique(h)


def signature(sets: np.ndarray) -> np.ndarray:
    """TREES x LONGEST symbols: a hash of the least value of each permutation of the shingles."""
    low = np.full(TREES * LONGEST, np.iinfo(np.uint32).max, np.uint32)
    x = (sets >> U(32)).astype(np.uint32)[:, None]
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 256):
            np.minimum(low, (x[k : k + 256] * _factors + _offsets).min(0), out=low)
        return (mix(low.astype(U) + (_columns << U(32))) >> U(56)).astype(np.uint8).reshape(TREES, LONGEST)


def _signed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Signatures as numbers that sort like them: of each tree eight symbols (high) and four (low)."""
    for part in parts:
        sets = [shingles(t) for t in part["text"]]
        signs = [signature(s) if len(s) else np.zeros((0, LONGEST), np.uint8) for s in sets]
        yield pd.DataFrame({
            "uid": part["uid"], "doc_id": part["doc_id"], "text_key": part["text_key"],
            "digest": [blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "size": [len(s) for s in sets],
            "high": [np.ascontiguousarray(x[:, :8]).view(">i8").ravel().astype(np.int64) for x in signs],
            "low": [np.ascontiguousarray(x[:, 8:]).view(">i4").ravel().astype(np.int32) for x in signs],
        })


SIGNED = "uid long, doc_id long, text_key long, digest binary, size int, high array<long>, low array<int>"

# ---------------------------------------------------------------- the forest


def matched(high: np.ndarray, low: np.ndarray, other_high: np.ndarray, other_low: np.ndarray) -> np.ndarray:
    """Symbols that two signatures of one tree have in common from the first on."""
    x, y = (high ^ other_high).view(U), (low ^ other_low).view(np.uint32)
    n = sum((x >> U(64 - 8 * k) == 0).astype(np.int32) for k in range(1, 8)) + (x == 0)
    return n + np.where(x == 0, sum((y >> np.uint32(32 - 8 * k) == 0).astype(np.int32) for k in range(1, 4)) + (y == 0), 0)


TIE = "part int, a long, b long, tree int, high long, low int, lcp int"
#: lcp of the first and the last row of a partition, which are handed on whole.
FIRST, LAST = -1, -2


def _neighbours(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted leaves, each with the one before it and the prefix they match in, if it is long enough."""
    number, last = TaskContext.get().partitionId(), None
    columns = ["tree", "high", "low", "uid"]

    def end(row: np.ndarray, mark: int) -> pd.DataFrame:
        tree, high, low, uid = row
        return pd.DataFrame({"part": [number], "a": [uid], "b": [uid], "tree": [tree], "high": [high], "low": [low], "lcp": [mark]})

    for part in parts:
        if not len(part):
            continue
        tree, high, low, uid = (part[c].to_numpy() for c in columns)
        if last is None:
            yield end((tree[0], high[0], low[0], uid[0]), FIRST)
        else:
            tree, high, low, uid = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(last, (tree, high, low, uid), strict=True))
        last = tree[-1], high[-1], low[-1], uid[-1]
        lcp = np.where(tree[1:] == tree[:-1], matched(high[1:], low[1:], high[:-1], low[:-1]), 0)
        keep = lcp >= SHORTEST
        yield pd.DataFrame({"part": number, "a": uid[:-1][keep], "b": uid[1:][keep], "tree": tree[1:][keep], "high": high[1:][keep], "low": low[1:][keep], "lcp": lcp[keep]})
    if last is not None:
        yield end(last, LAST)


def ties(signed: DataFrame) -> DataFrame:
    """a, b, lcp: sets that are neighbours in the sorted order of a tree, and the length of their common prefix.

    Sorting is by tree, signature and uid, so a node of any number of sets is spread over as many tasks as it needs.
    """
    leaves = signed.select("uid", F.posexplode(F.arrays_zip("high", "low")).alias("tree", "x")).select("uid", "tree", F.col("x.high").alias("high"), F.col("x.low").alias("low"))
    order = ("tree", "high", "low", "uid")
    found = materialize(leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_neighbours, TIE), "ties")
    # Where two partitions meet; two rows of each partition reach the driver.
    ends = found.filter("lcp < 0").toPandas()
    ends = ends.sort_values(["part", "lcp"], ascending=[True, False], kind="stable")
    before, after = ends[ends["lcp"] == LAST].iloc[:-1], ends[ends["lcp"] == FIRST].iloc[1:]
    lcp = np.where(before["tree"].to_numpy() == after["tree"].to_numpy(), matched(*(x[c].to_numpy() for x in (after, before) for c in ("high", "low"))), 0)
    seams = [(int(a), int(b), int(n)) for a, b, n in zip(before["a"], after["a"], lcp, strict=True) if n >= SHORTEST]
    inner = found.filter("lcp >= 0").select("a", "b", "lcp")
    return inner.unionByName(signed.sparkSession.createDataFrame(seams, "a long, b long, lcp int")) if seams else inner


def found_at(similarity: np.ndarray, length: int) -> np.ndarray:
    """Chance that sets of a similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** TREES


def prefix_length(counts: dict[int, int], recall: float = RECALL) -> int:
    """The longest prefix length with the recall, for so many links of each number of equal symbols.

    Beside the links seen, LEAST_SIMILAR as many are taken to be as unlike as links can be.
    """
    symbols = TREES * LONGEST
    seen = np.clip((np.array(list(counts), float) / symbols - 1 / 256) / (1 - 1 / 256), 0, 1)
    n = np.array(list(counts.values()), float)
    seen, n = seen[seen >= SIMILARITY], n[seen >= SIMILARITY]
    seen, n = np.append(seen, SIMILARITY), np.append(n, max(1.0, LEAST_SIMILAR * n.sum()))
    return next((k for k in range(LONGEST, SHORTEST, -1) if (n * found_at(seen, k)).sum() >= recall * n.sum()), SHORTEST)


def _equal_symbols(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        same = [
            int((np.asarray(h, np.int64).view(np.uint8) == np.asarray(g, np.int64).view(np.uint8)).sum() + (np.asarray(l, np.int32).view(np.uint8) == np.asarray(m, np.int32).view(np.uint8)).sum())
            for h, l, g, m in zip(part["high"], part["low"], part["other_high"], part["other_low"], strict=True)
        ]
        yield pd.DataFrame({"same": same})


def likely_links(signed: DataFrame, found: DataFrame) -> dict[int, int]:
    """Of every tied set and the set it meets in most trees: how many of them have so many equal symbols."""
    best = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("lcp").alias("lcp")).groupBy("b").agg(F.max(F.struct("n", "lcp", "a")).alias("x")).select("b", F.col("x.a").alias("a"))
    one = signed.select(F.col("uid").alias("a"), "high", "low")
    other = signed.select(F.col("uid").alias("b"), F.col("high").alias("other_high"), F.col("low").alias("other_low"))
    same = best.join(one.hint("merge"), "a").join(other.hint("merge"), "b").select("high", "low", "other_high", "other_low").mapInPandas(_equal_symbols, "same int")
    return {r.same: r.n for r in same.groupBy("same").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 385 rows


# ---------------------------------------------------------------- exact comparison


def _linked(sets: list[np.ndarray], block: np.ndarray) -> np.ndarray:
    """Which pairs have the similarity: a symmetric matrix, only across blocks where there are two."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    shared = np.zeros((n, n), np.float32)
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    common = count > 1
    column = np.cumsum(common) - 1
    keep = common[code]
    owner, code = owner[keep], column[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    edges = np.searchsorted(code, np.arange(0, int(common.sum()) + COLUMNS, COLUMNS))
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        x = np.zeros((n, COLUMNS), np.float32)
        x[owner[low:high], code[low:high] - k * COLUMNS] = 1
        shared += x @ x.T
    out = 9 * shared >= 4 * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(out, False)
    if len(np.unique(block)) > 1:
        out &= block[:, None] != block[None, :]
    return out


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """For each set its links, counted in documents, and the least set it is tied to in this pair of blocks."""
    group = group.drop_duplicates("uid").sort_values("uid", ignore_index=True)
    if len(group) < 2 or (group["one"].iloc[0] != group["two"].iloc[0] and group["block"].nunique() < 2):
        return pd.DataFrame({"uid": [], "root": [], "links": []}).astype("int64")
    links = _linked([shingles(t) for t in group["text"]], group["block"].to_numpy())
    root = np.arange(len(group))
    while True:
        new = np.minimum(root, np.where(links, root[None, :], len(group)).min(1))
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    uid = group["uid"].to_numpy()
    return pd.DataFrame({"uid": uid, "root": uid[root], "links": links.astype(np.int64) @ group["n"].to_numpy()})


def blocks_of(members: DataFrame) -> DataFrame:
    """Members (label, size and more) with block, and others: the blocks of their group that they are compared with.

    A group that is more than a block is parted by size into bands in the ratio of SIMILARITY, and a band into
    blocks: sets two bands apart are too unlike in size to be linked, and neighbouring bands meet.
    """
    needed = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    whole = members.groupBy("label").agg(needed().alias("all"))
    band = F.when(F.col("all") > 1, F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(float(np.log(1 / SIMILARITY))))).otherwise(0).cast("int")
    members = members.join(whole, "label").withColumn("band", band).drop("all")
    bands = materialize(members.groupBy("label", "band").agg(needed().alias("blocks")), "bands")
    met = bands.select("label", F.col("band").alias("other_band"), F.col("blocks").alias("other_blocks"))
    mine = bands.select("label", "band", "blocks", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("other_band"))
    code = lambda band, block: F.shiftleft(band.cast("long"), 32) + block
    others = mine.join(met, ["label", "other_band"]).groupBy("label", "band", "blocks").agg(
        F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0), F.col("other_blocks") - 1), lambda k: code(F.col("other_band"), k)))).alias("others")
    )
    block = code(F.col("band"), F.pmod(F.xxhash64("uid"), F.col("blocks")))
    return members.join(others, ["label", "band"]).withColumn("block", block).drop("band", "blocks")


def _keyed(docs: DataFrame) -> list[Column]:
    return [F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("key"), F.xxhash64(text_or_empty()).alias("text_key")]


def near_classes(spark: SparkSession, docs: DataFrame, uid: Column | None = None) -> DataFrame:
    """uid, doc_id, class_id, n_links, set_id, class_label for every row; uid tells rows apart.

    set_id is the least uid among documents of the same shingle set, class_label the least set_id of the class.
    """
    prepare(spark)
    uid = F.monotonically_increasing_id() if uid is None else uid
    key, text_key = _keyed(docs)  # pandas would turn ids beside a null into floats, hence the key
    signed = docs.select(uid.alias("uid"), key.alias("doc_id"), text_key, text_or_empty().alias("text")).mapInPandas(lambda parts: freed(_signed(parts)), SIGNED)
    signed = materialize(signed.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID))), "signatures")
    sets = materialize(signed.groupBy("digest").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least_id")), "sets")

    # Joins are hinted to merge, so that plans and what they move are alike at every size.
    one_each = signed.select("uid", "high", "low").join(sets.select("uid").hint("merge"), "uid", "left_semi")
    found = ties(one_each)
    length = prefix_length(likely_links(signed.select("uid", "high", "low"), found))
    groups = materialize(components(found.filter(F.col("lcp") >= length).select("a", "b")), "groups")

    # All pairs of a group meet once, as texts, in the task of their block pair.
    members = groups.withColumnRenamed("id", "uid").join(sets.select("uid", "n").hint("merge"), "uid").join(signed.select("uid", "doc_id", "text_key", "size").hint("merge"), "uid")
    members = blocks_of(materialize(members, "grouped")).select("uid", "n", "label", "block", "others", F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), "text_key")
    members = materialize(members, "members")
    texts = docs.select(*_keyed(docs), text_or_empty().alias("text"))
    if may_hold := sent_filter(members.select(F.col("text_key").alias("k")).distinct()):
        texts = texts.filter(may_hold(F.col("text_key")))
    texts = texts.join(members.hint("merge"), ["key", "text_key"])
    pairs = texts.withColumn("other", F.explode("others")).select("uid", "n", "label", "block", "text", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    compared = materialize(pairs.groupBy("label", "one", "two").applyInPandas(_compare, "uid long, root long, links long"), "compared")
    tied = compared.filter("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b"))
    labels = components(tied).withColumnRenamed("id", "uid").withColumnRenamed("label", "class_label")
    links = compared.groupBy("uid").agg(F.sum("links").alias("links"))

    known = sets.join(links, "uid", "left").join(labels, "uid", "left").select(
        "digest", F.col("uid").alias("set_id"), F.coalesce("class_label", "uid").alias("class_label"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least_id"
    )
    known = materialize(known, "set-classes")
    ids = known.groupBy("class_label").agg(F.min("least_id").alias("class_id"))
    known = materialize(known.join(ids, "class_label").drop("least_id"), "classes")
    return signed.select("uid", "doc_id", "digest").join(known, "digest").select("uid", "doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "set_id", "class_label")


def representatives(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of docs for each class, the first of its least set, with its columns."""
    uid = fresh(docs, "uid")
    stored = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "near-input")
    kept = near_classes(spark, stored, F.col(uid)).filter("uid = class_label").select(F.col("uid").alias(uid))
    return stored.join(kept, uid, "left_semi").select(*docs.columns)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark, documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")
