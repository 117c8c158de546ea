"""Regex matches with offsets, which Spark's functions don't give: patterns that tile the text, and running lengths.

Offsets are in code points from 0, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import word_count

#: A sentence, or a character between sentences. The first alternative is a fixed value, the others fill the gaps.
SENTENCE_TILE = r"[^\n.!?]+(?:[.!?](?=\s|$)|$)|[^\n.!?]+|[\n.!?]"
#: A sentence that ends in one of these words is cut off.
DANGLING = r"(?i)(?:^|[^\p{L}\p{N}_])(?:and|or|between|from|to|by|of|the)\s*$"


def exploded_words(rows: DataFrame, text: str) -> DataFrame:
    """rows with a row for each word: n (from 0), start, end. Running sums need the rows' key columns to be unique."""
    keys = [c for c in rows.columns if c != text]
    tiles = rows.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\s*\S+"), F.lit(0))).alias("n", "tile"))
    end = F.sum(F.length("tile")).over(Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return tiles.select(*keys, "n", (end - F.length(F.regexp_replace("tile", r"^\s+", ""))).cast("int").alias("start"), end.cast("int").alias("end"))


def sentences(rows: DataFrame, text: str, least_words: int = 5) -> DataFrame:
    """rows (unique keys) with a row for each sentence: sentence, start, end."""
    keys = [c for c in rows.columns if c != text]
    tiles = rows.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SENTENCE_TILE), F.lit(0))).alias("n", "tile"))
    end = F.sum(F.length("tile")).over(Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    left = F.length("tile") - F.length(F.regexp_replace("tile", r"^\s+", ""))
    body = F.regexp_replace(F.regexp_replace("tile", r"^\s+", ""), r"\s+$", "")
    out = tiles.withColumns({"_from": end - F.length("tile") + left, "sentence": body})
    # A run of characters that no terminator before white space ends is no sentence.
    whole = F.col("tile").rlike(r"[.!?]$") | (end == F.sum(F.length("tile")).over(Window.partitionBy(*keys)))
    out = out.withColumn("_whole", whole)
    good = F.col("_whole") & (word_count("sentence") >= least_words) & ~F.col("sentence").rlike(DANGLING)
    return out.filter(good).select(*keys, "sentence", F.col("_from").cast("int").alias("start"), (F.col("_from") + F.length("sentence")).cast("int").alias("end"))
