"""Character and byte-pair tokenizers, unigram and bigram models.

Distinct words stay on executors while byte-pair merges are learned; the driver gets the parts of words that only
the most frequent pairs hold together. Counting, encoding and scoring are distributed. Null texts are skipped.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, prepare
from . import counting as N

#: Ids 0 to 3.
SPECIAL = ("<PAD>", "<UNK>", "<BOS>", "<EOS>")
#: A word, or one other character that is no white space (of Unicode).
WORD_PIECE = r"[a-zA-Z']+|[^a-zA-Z'\s\x1c-\x1f\x85\p{Z}]"
END = "</w>"
ALPHA = 0.1


def char_vocab(rows: DataFrame, text: str) -> DataFrame:
    """char, id: the distinct characters in code point order after the special ids."""
    chars = rows.select(F.explode(F.split(text, "")).alias("char")).filter("char <> ''").distinct()
    return chars.select("char", (F.row_number().over(Window.orderBy("char")) + len(SPECIAL) - 1).cast("int").alias("id"))  # a row for each character


def char_encode(rows: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """key, ids; unknown characters are 1. The vocabulary is joined by character, ids return in order."""
    chars = rows.select(key, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("n", "char"))
    found = chars.join(vocab.withColumnRenamed("id", "_id"), "char", "left")
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("_id", F.lit(1)).alias("_id")))), lambda x: x["_id"]).alias("ids"))


def char_decode(rows: DataFrame, key: str, ids: str, vocab: DataFrame) -> DataFrame:
    """key, text; special ids are left out, unknown ones become `?`."""
    flat = rows.select(key, F.posexplode(ids).alias("n", "_id")).filter(~F.col("_id").isin(0, 2, 3))
    found = flat.join(vocab.withColumnRenamed("id", "_id"), "_id", "left")
    return found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("char", F.lit("?")).alias("char")))), lambda x: x["char"]), "").alias("text"))


def word_freqs(rows: DataFrame, text: str, order: str | None = None) -> DataFrame:
    """word, n, and where it first occurs (first) if rows have an order."""
    found = rows.select(*([F.col(order).alias("o")] if order else []), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(WORD_PIECE), F.lit(0))).alias("p", "word"))
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min(F.struct("o", "p")).alias("first")] if order else [])
    return found.groupBy("word").agg(*aggs)


def pair_counts(freqs: DataFrame) -> DataFrame:
    """left, right, n: adjacent symbols of all words, by the words' counts."""
    symbols = F.concat(F.filter(F.split("word", ""), lambda c: c != ""), F.array(F.lit(END)))
    rows = freqs.select("n", symbols.alias("s"))
    pairs = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return rows.select("n", F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def train_bpe(freqs: list[tuple[str, int]], merges: int = 1000) -> list[tuple[str, str]]:
    """Merges of the most frequent pair in turn, over (word, count) in order of first occurrence."""
    return _merge([[*w, END] for w, _ in freqs], [n for _, n in freqs], merges)


def _merge(words: list[list[str]], counts: list[int], merges: int, least: int = 1) -> list[tuple[str, str]]:
    """Merges of the most frequent pair in turn while one occurs least times; words are lists of symbols, changed in place.

    Pairs keep an index of the words that hold them, so a merge touches those words alone. Ties go to the pair
    met first when words are read in order.
    """
    total: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, symbols in enumerate(words):
        for pair in zip(symbols, symbols[1:], strict=False):
            total[pair] += counts[k]
            where[pair].add(k)

    def first(pair: tuple[str, str]) -> tuple[int, int]:
        k = min(where[pair])
        s = words[k]
        return k, next(i for i in range(len(s) - 1) if (s[i], s[i + 1]) == pair)

    out = []
    for _ in range(merges):
        if not total:
            break
        most = max(total.values())
        if most < least:
            break
        best = min((p for p, n in total.items() if n == most), key=first)
        out.append(best)
        for k in sorted(where[best]):
            s, new, i = words[k], [], 0
            for pair in zip(s, s[1:], strict=False):
                total[pair] -= counts[k]
                where[pair].discard(k)
                if total[pair] <= 0:
                    del total[pair]
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == best:
                    new.append(s[i] + s[i + 1])
                    i += 2
                else:
                    new.append(s[i])
                    i += 1
            words[k] = new
            for pair in zip(new, new[1:], strict=False):
                total[pair] += counts[k]
                where[pair].add(k)
    return out


#: Symbols are code points; the end of a word and merged symbols come after them.
FIRST_SYMBOL = 0x110000
#: Words in a row of the learning state, parts of words that the driver gets at once, and merges after which the state is written anew.
WORD_BLOCK, MOST_PARTS, PENDING = 50_000, 50_000, 100


def _joined(flat: np.ndarray, a: int, b: int, to: int) -> np.ndarray:
    """flat with every a, b replaced by to, from left to right."""
    at = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b))
    if a == b and len(at):
        run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
        at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
    if not len(at):
        return flat
    out = flat.copy()
    out[at] = to
    return np.delete(out, at + 1)


def learn_bpe(freqs: DataFrame, merges: int = 1000) -> list[tuple[str, str]]:
    """What train_bpe learns of freqs (word, n, first), while the words stay on executors.

    A round takes the pairs that occur `least` times and more. A merge makes new pairs only where two symbols meet, and
    no oftener than those two met before; so until the best pair occurs fewer than `least` times, words may be cut
    wherever rarer pairs meet, and equal parts of words be added up. The driver merges those parts, the next round goes
    on with words that have the merges. Parts are ordered by the first word that holds them and their place in it.
    """
    prepare(freqs.sparkSession)

    def state(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), WORD_BLOCK):
                some = part.iloc[at : at + WORD_BLOCK]
                words = ["".join(w) for w in some["word"]]
                flat = np.full(sum(map(len, words)) + 2 * len(words), -1, np.int32)
                stops = np.cumsum([len(w) + 2 for w in words])
                inside = np.ones(len(flat), bool)
                inside[stops - 1] = inside[stops - 2] = False
                flat[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
                flat[stops - 2] = FIRST_SYMBOL
                yield pd.DataFrame({"flat": [flat.tobytes()], "n": [some["n"].to_numpy(np.int64).tobytes()], "k": [some["k"].to_numpy(np.int64).tobytes()]})

    kind = "flat binary, n binary, k binary"
    ordered = freqs.orderBy("first", "word").select("word", "n", F.monotonically_increasing_id().alias("k"))  # ids grow with the order
    held = checkpointed(ordered.mapInPandas(state, kind))
    ids, names = {END: FIRST_SYMBOL}, {FIRST_SYMBOL: END}
    out: list[tuple[str, str]] = []
    pending: list[tuple[int, int, int]] = []
    many = 64

    def number(symbol: str) -> int:
        if len(symbol) == 1:
            return ord(symbol)
        if symbol not in ids:
            ids[symbol] = FIRST_SYMBOL + len(ids)
            names[ids[symbol]] = symbol
        return ids[symbol]

    name = lambda i: names[i] if i >= FIRST_SYMBOL else chr(i)

    def merged(part: pd.DataFrame, todo: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for flat, n, k in zip(part["flat"], part["n"], part["k"], strict=True):
            flat = np.frombuffer(flat, np.int32)
            for a, b, to in todo:
                flat = _joined(flat, a, b, to)
            yield flat, np.frombuffer(n, np.int64), np.frombuffer(k, np.int64)

    def pairs_of(todo: list):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for flat, n, _ in merged(part, todo):
                    word = np.cumsum(flat < 0)
                    at = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
                    codes, of = np.unique(flat[at].astype(np.int64) << 32 | flat[at + 1], return_inverse=True)
                    total = np.zeros(len(codes), np.int64)
                    np.add.at(total, of, n[word[at]])
                    yield pd.DataFrame({"pair": codes, "n": total})

        return run

    def parts_of(todo: list, chosen: np.ndarray):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for flat, n, k in merged(part, todo):
                    word = np.cumsum(flat < 0)
                    tied = np.isin(flat[:-1].astype(np.int64) << 32 | np.maximum(flat[1:], 0), chosen) & (flat[:-1] >= 0) & (flat[1:] >= 0)
                    edge = np.diff(np.concatenate([[0], tied.astype(np.int8), [0]]))
                    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
                    first = np.concatenate([[0], np.flatnonzero(flat < 0) + 1])
                    found: dict[bytes, list[int]] = {}
                    raw = flat.tobytes()
                    for a, b, w in zip(starts.tolist(), stops.tolist(), word[starts].tolist(), strict=True):
                        key = raw[4 * a : 4 * b]
                        if (x := found.get(key)) is None:
                            found[key] = [n[w], k[w], a - first[w]]  # words of a block are in order
                        else:
                            x[0] += n[w]
                    if found:
                        total, at, place = zip(*found.values(), strict=True)
                        yield pd.DataFrame({"part": list(found), "n": total, "k": at, "place": place})

        return run

    while len(out) < merges:
        top = held.mapInPandas(pairs_of(list(pending)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair")
        some = top.limit(many + 1).collect()
        if not some:
            break
        least = some[many]["n"] + 1 if len(some) > many else 1
        if least > some[0]["n"]:  # many pairs tie for the first place: take them all, and only them
            least = some[0]["n"]
            some = top.filter(F.col("n") == least).collect()
        chosen = np.array([r["pair"] for r in some if r["n"] >= least], np.int64)
        parts = held.mapInPandas(parts_of(list(pending), chosen), "part binary, n long, k long, place long").groupBy("part").agg(F.sum("n").alias("n"), F.min(F.struct("k", "place")).alias("first"))
        few = some[0]["n"] == some[len(chosen) - 1]["n"]  # fewer pairs can't be chosen
        rows = (parts if few else parts.limit(MOST_PARTS + 1)).collect()
        if len(rows) > MOST_PARTS and not few:
            many = max(1, len(chosen) // 2)
            continue
        rows.sort(key=lambda r: (r["first"]["k"], r["first"]["place"]))
        new = _merge([[name(i) for i in np.frombuffer(r["part"], np.int32).tolist()] for r in rows], [r["n"] for r in rows], merges - len(out), least)
        out += new
        pending += [(number(a), number(b), number(a + b)) for a, b in new]
        if len(rows) < MOST_PARTS // 4:
            many *= 2
        if len(pending) >= PENDING and len(out) < merges:
            todo = list(pending)

            def applied(parts: Iterator[pd.DataFrame], todo: list = todo) -> Iterator[pd.DataFrame]:
                for part in parts:
                    for flat, n, k in merged(part, todo):
                        yield pd.DataFrame({"flat": [flat.tobytes()], "n": [n.tobytes()], "k": [k.tobytes()]})

            held, pending = checkpointed(held.mapInPandas(applied, kind)), []
    return out


def bpe_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols of a word after all merges in learned order."""
    s = [*word, END]
    while len(s) > 1:
        rank, best = min((ranks.get(p, 1 << 30), p) for p in zip(s, s[1:], strict=False))
        if rank == 1 << 30:
            break
        new, i = [], 0
        while i < len(s):
            if i + 1 < len(s) and (s[i], s[i + 1]) == best:
                new.append(s[i] + s[i + 1])
                i += 2
            else:
                new.append(s[i])
                i += 1
        s = new
    return s


#: Words that a task remembers, and texts that it splits at a time.
WORDS_KEPT, TEXT_BLOCK = 200_000, 500


def bpe_encode(rows: DataFrame, key: str, text: str, merges: list[tuple[str, str]]) -> DataFrame:
    """key, tokens of rows with a word: a task splits each word once while it remembers it, in Arrow batches."""
    prepare(rows.sparkSession)
    ranks = {p: k for k, p in enumerate(merges)}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[str]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_BLOCK):
                some = batch.slice(at, TEXT_BLOCK)
                words = some.column(1)
                of = words.flatten().dictionary_encode()
                if len(kept) > WORDS_KEPT:
                    kept.clear()
                pieces = []
                for w in of.dictionary.to_pylist():
                    if (found := kept.get(w)) is None:
                        found = kept[w] = bpe_word(w, ranks)
                    pieces.append(found)
                known = pa.array(pieces, pa.list_(pa.string()))
                starts, sizes = known.offsets.to_numpy()[:-1].astype(np.int64), np.diff(known.offsets.to_numpy()).astype(np.int64)
                index = of.indices.to_numpy(zero_copy_only=False)
                size = sizes[index]
                stops = np.cumsum(size)
                tokens = known.flatten().take(pa.array(np.arange(size.sum()) + np.repeat(starts[index] - (stops - size), size)))
                ends = np.concatenate([[0], stops])[words.offsets.to_numpy() - words.offsets[0].as_py()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)], names=[key, "tokens"])

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(key, F.regexp_extract_all(F.col(text), F.lit(WORD_PIECE), F.lit(0)).alias("words")).filter("size(words) > 0")
    return found.mapInArrow(split, f"`{key}` {kind}, tokens array<string>")


def bpe_vocab(freqs: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """token, id: the symbols that words (word) consist of after all merges, in code point order after the special ids."""
    whole = freqs.select(F.col("word").alias("_w"), F.col("word").alias("_t"))
    tokens = bpe_encode(whole, "_w", "_t", merges).select(F.explode("tokens").alias("token")).distinct()
    return tokens.select("token", (F.row_number().over(Window.orderBy("token")) + len(SPECIAL) - 1).cast("int").alias("id"))  # at most a row for each merge and character


def bpe_ids(tokens: DataFrame, key: str, vocab: DataFrame, special: bool = False) -> DataFrame:
    """key, ids of rows (key, tokens); tokens without an id are 1; special adds 2 before and 3 behind.

    A row without tokens has no ids but the special ones.
    """
    flat = tokens.select(key, F.posexplode_outer("tokens").alias("n", "token"))
    found = flat.join(vocab.withColumnRenamed("id", "_id"), "token", "left")
    known = F.when(F.col("token").isNotNull(), F.struct("n", F.coalesce("_id", F.lit(1)).alias("_id")))
    out = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(known)), lambda x: x["_id"]).alias("ids"))
    return out.withColumn("ids", F.concat(F.array(F.lit(2)), "ids", F.array(F.lit(3)))) if special else out


def bpe_decode(rows: DataFrame, key: str, ids: str, vocab: DataFrame) -> DataFrame:
    """key, text: ends of words become spaces, special ids are left out, unknown ones become `?`."""
    flat = rows.select(key, F.posexplode_outer(ids).alias("n", "_id"))
    found = flat.join(vocab.withColumnRenamed("id", "_id"), "_id", "left")
    part = F.when(F.col("_id").isNotNull() & ~F.col("_id").isin(0, 2, 3), F.struct("n", F.coalesce("token", F.lit("?")).alias("token")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["token"]), "")
    return found.groupBy(key).agg(F.trim(F.replace(text, F.lit(END), F.lit(" "))).alias("text"))


def unigram_perplexity(train: DataFrame, held: DataFrame, token: str, alpha: float = ALPHA) -> DataFrame:
    """perplexity of held tokens under add-alpha counts of train; the vocabulary is train's and held's together."""
    counts = train.groupBy(token).agg(F.count(F.lit(1)).alias("c"))
    totals = train.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(train.select(token).union(held.select(token)).distinct().agg(F.count(F.lit(1)).alias("v"))))  # one row each
    asked = held.groupBy(token).agg(F.count(F.lit(1)).alias("m")).join(counts, token, "left").join(F.broadcast(totals))
    logp = F.log((F.coalesce("c", F.lit(0)) + alpha) / (F.col("n") + alpha * F.col("v")))
    return asked.agg(F.exp(-F.sum(F.col("m") * logp) / F.sum("m")).alias("perplexity"))


def bigrams(rows: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """left, right of tokens that follow one another within a key."""
    after = F.lead(token).over(Window.partitionBy(key).orderBy(order))
    return rows.select(F.col(token).alias("left"), after.alias("right")).filter("right IS NOT NULL")


def bigram_perplexity(train: DataFrame, held: DataFrame, key: str, order: str, token: str, alpha: float = ALPHA) -> DataFrame:
    """Like unigram_perplexity; a context counts as often as its token occurs, the last one too."""
    context = train.groupBy(F.col(token).alias("left")).agg(F.count(F.lit(1)).alias("c1"))
    pairs = bigrams(train, key, order, token).groupBy("left", "right").agg(F.count(F.lit(1)).alias("c2"))
    v = train.select(token).union(held.select(token)).distinct().agg(F.count(F.lit(1)).alias("v"))
    asked = bigrams(held, key, order, token).groupBy("left", "right").agg(F.count(F.lit(1)).alias("m"))
    return _bigram_perplexity(asked.join(pairs, ["left", "right"], "left"), context, v, alpha)


def bigram_perplexity_of_texts(train: DataFrame, held: DataFrame, text: str, alpha: float = ALPHA) -> DataFrame:
    """bigram_perplexity over the search tokens of texts, whose pairs are counted where the texts are, without their order as rows."""

    def count(rows: DataFrame, terms: Callable[[str], list[str]], name: str) -> DataFrame:
        return N.totals(rows, F.col(text), terms).withColumnRenamed("n", name)

    context = checkpointed(count(train, N.search_terms, "c1")).withColumnRenamed("term", "left")  # read twice
    v = context.select("left").union(count(held, N.search_terms, "m").select("term")).distinct().agg(F.count(F.lit(1)).alias("v"))
    left = F.split_part("term", F.lit(" "), F.lit(1))  # a token holds no space
    asked = count(held, N.search_pairs, "m").join(count(train, N.search_pairs, "c2"), "term", "left")
    return _bigram_perplexity(asked.select(left.alias("left"), "m", "c2"), context, v, alpha)


def _bigram_perplexity(asked: DataFrame, context: DataFrame, v: DataFrame, alpha: float) -> DataFrame:
    rows = asked.join(context, "left", "left").join(F.broadcast(v))  # one row of v
    logp = F.log((F.coalesce("c2", F.lit(0)) + alpha) / (F.coalesce("c1", F.lit(0)) + alpha * F.col("v")))
    return rows.agg(F.exp(-F.sum(F.col("m") * logp) / F.sum("m")).alias("perplexity"))
