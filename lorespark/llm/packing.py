"""Packing token sequences: shortest-pack-first over the length histogram (Krell et al., 2021).

A document's ids are cut into pieces; equal lengths are interchangeable, so packing works on the histogram of
lengths, longest first: each length goes onto the open packs that hold least so far. The outcome is a set of
patterns with counts, and pieces find their place by their rank among the pieces of their length.

Rows: a null text is an empty text, whose one id is the end id; repeated rows are packed each; ties in rank go
by hash of the id, then id, start and checksum, and rows equal in all are interchangeable; a null doc_id is
carried as null; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, documents, freed, materialize, prepare

LENGTH = 2048
END_ID = 1
#: Words in each of the two generations that a worker remembers, of at most so many characters: about 30 MB each.
WORDS, LONGEST_WORD = 220_000, 32

#: Bytes that the file's vocabulary writes as other characters; the others stand for themselves.
HIDDEN = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SLOT = "length long, low long, high long, first_sequence long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memory(dict):
    """Ids by word in two generations: a full young one takes the old one's place, and words in use come back from it."""

    def __init__(self, ask: Callable[[str], bytes]) -> None:
        self.ask = ask
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.ask(word)
            if len(word) > LONGEST_WORD:
                return ids
        if len(self) >= WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """Ids of texts, word by word with a memory; the same ids as Tokenizer.encode gives for the whole text.

    The file's pre-tokenizer never lets a word depend on its neighbours. Texts with characters on which
    Python's and the file's normalisers might differ go through the tokenizer as a whole.
    """

    ASCII = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9]+")
    #: The same for letters and numbers of Latin scripts, which ODD lets pass.
    LATIN = re.compile(r"[a-zªµºÀ-ÖØ-öø-ɏ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|[^\sa-z0-9ªµºÀ-ÖØ-öø-ɏ²³¹¼-¾]+")
    #: Capitals of Latin scripts whose small letters those patterns don't know.
    CAPITALS = "".join(c for c in map(chr, range(0x250)) if max(c.lower()) > "ɏ")
    ODD = re.compile(f"[\x7f-\xa0{CAPITALS}]|[^\x00-ɏ‐-‧‰-⁞]")
    #: Of ASCII: control characters that only Python has for spaces, and the start of a special token.
    ODD_ASCII = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Memory(self._word)

    def _word(self, word: str) -> bytes:
        """Of a lower-case word as the patterns find it: the normaliser and the pre-tokenizer would only write its bytes."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(HIDDEN)
        return _packed([x.id for x in self.model.tokenize(word)])

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _words(self, text: str) -> list[str] | None:
        if any(x in text for x in self.ODD_ASCII):
            return None
        if text.isascii():
            return self.ASCII.findall(text.lower())
        return None if self.ODD.search(text) else self.LATIN.findall(text.lower())

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        words = self._words(text)
        return self._whole(text) if words is None else b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """A row for each piece of at most length ids."""
    prepare(docs.sparkSession)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, step = encoder(path).encode, 4 * length
        end = _packed([END_ID])
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"].tolist(), part["text"], strict=True):
                ids = encode(text or "") + end
                rows += [(doc_id, b // 4, len(x) // 4, zlib.crc32(x), len(ids) // 4) for b in range(0, len(ids), step) if (x := ids[b : b + step])]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    # pandas would turn ids beside a null into floats
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("doc_id"), "text").mapInPandas(lambda parts: freed(cut(parts)), PIECE)
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """(count, lengths) pairs that use each length as often as the histogram says."""
    open_: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by room left
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            room = max((r for r, packs in open_.items() if packs), default=0)
            if room < size:
                open_[length - size].append((n, [size]))
                break
            count, held = open_[room].pop()
            used = min(n, count)
            if count > used:
                open_[room].append((count - used, held))
            open_[room - size].append((used, [*held, size]))
            n -= used
    return [pack for room in sorted(open_) for pack in open_[room]]


def slots(packs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Of each length, ranks from low to high (without) stand at offset in the sequences from first_sequence on."""
    out, taken, sequence = [], defaultdict(int), 0
    for count, held in packs:
        offset = 0
        for size in held:
            low = taken[size]
            out.append((size, low, low + count, sequence, offset))
            taken[size] += count
            offset += size
        sequence += count
    return out


def packed(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces (a stored table) with sequence_id and offset."""
    spark = rows.sparkSession
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `length` rows
    places = spark.createDataFrame(slots(patterns(histogram, length)), SLOT)
    # Rank within a length: hashes deal a length into parts, so that one common length is ranked in many tasks.
    salted = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("salt", F.shiftrightunsigned("h", 54))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("length", "salt", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("h", "doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = salted.withColumn("within", within).join(counts, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("before"))
    found = ranked.join(F.broadcast(places), "length").filter("rank >= low AND rank < high")  # a few patterns for each of `length` lengths
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    return packed(materialize(pieces(docs, path or default_tokenizer(), length), "pieces"), length)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
