"""Names looked up in texts, and years in ranges, by equi-joins.

Null and empty names or texts meet nothing; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold
from ..session import prepare
from .counting import BITS, asked_bits

#: Characters of a name's start by which it meets texts; shorter names meet them by all of theirs.
LONGEST_START = 6
#: Years that meet by one key.
YEARS = 10
#: Parts of a decade's rows, so that no task gets all of them.
SHARES = 256


def held_names(texts: DataFrame, names: DataFrame, least: int = 1) -> DataFrame:
    """text_id, name_id where a text (text_id, text) holds a name (name_id, name), whatever the case, inside words too.

    Names of fewer characters than least are left out. A bitmap of names' first characters, of one size whatever their
    number, says where in a text a name may start; what stands there, as long as the longest name, is joined with the
    names by those characters, and the whole name is then checked. Names are read several times.
    """
    prepare(texts.sparkSession)
    starts = names.filter(F.length("name") >= F.greatest(F.lit(least), F.lit(1))).select("name_id", casefold("name").alias("low")).distinct().withColumn("start", F.substring("low", 1, LONGEST_START))
    size = starts.agg(F.collect_set(F.length("start")).alias("n"), F.max(F.length("low")).alias("longest")).first()
    sizes, longest = sorted(size["n"]), size["longest"]

    def bucket(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [int(_buckets(x, len(x))[0]) for x in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["b"])

    bits = asked_bits(F.col("b"), starts.select("start").mapInArrow(bucket, "b int"))

    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        for part in parts:
            row, n, piece = [], [], []
            for k, body in enumerate(part.column(1).to_pylist()):
                for size in sizes:
                    found = {body[at : at + longest] for at in np.flatnonzero(there[_buckets(body, size)]).tolist()}
                    row += [k] * len(found)
                    n += [size] * len(found)
                    piece += found
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int32()), pa.array(piece, pa.string())], names=["text_id", "n", "piece"])

    bodies = texts.filter("text IS NOT NULL").select("text_id", casefold("text").alias("body"))
    kind = texts.schema["text_id"].dataType.simpleString()
    runs = bodies.mapInArrow(places, f"text_id {kind}, n int, piece string").withColumn("start", F.substr("piece", F.lit(1), F.col("n")))
    return runs.join(starts, "start").filter(F.startswith("piece", "low")).select("text_id", "name_id").distinct()


def _buckets(text: str, n: int) -> np.ndarray:
    """The bitmap's place of each run of n characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    many = len(codes) - n + 1
    h = np.zeros(max(many, 0), np.uint32)
    for k in range(n if many > 0 else 0):
        h = (h ^ codes[k : many + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def overlapping(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Columns of both where rows (start_year, end_year; a null end is the start) begin by high and end from low on.

    So they overlap a range (low, high); one given the wrong way round is met by rows that span it. Rows that end
    before they start meet nothing.
    """
    decades = lambda a, b: F.explode(F.sequence(F.floor(a / YEARS), F.floor(b / YEARS)))
    end = F.coalesce("end_year", "start_year")
    # Rows of one decade are dealt into SHARES by hash, as few decades may hold all rows; ranges go to every share.
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(SHARES)).cast("int")
    left = rows.filter((F.col("start_year") <= end)).withColumn("share", share).withColumn("decade", decades(F.col("start_year"), end))
    right = ranges.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).withColumn("decade", decades(F.least("low", "high"), F.greatest("low", "high"))).filter("low IS NOT NULL AND high IS NOT NULL")
    met = left.join(right, ["decade", "share"]).filter((F.col("start_year") <= F.col("high")) & (end >= F.col("low")))
    # Both sides list the decades they share; the pair counts in the first of them.
    return met.filter(F.col("decade") == F.greatest(F.floor(F.col("start_year") / YEARS), F.floor(F.least("low", "high") / YEARS))).drop("decade", "share")
