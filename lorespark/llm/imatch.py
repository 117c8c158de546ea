"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

Chowdhury et al., "Collection Statistics for Fast Duplicate Document Detection", 2002; Kolcz et al., "Improved
Robustness of Signature-Based Near-Replica Detection via Lexicon Randomization", 2004. Terms whose inverse
document frequency lies in a band form the lexicon; a text keeps its distinct terms of the lexicon, sorted,
and each random subset of the lexicon gives one hash of those it keeps. Subsets thin out geometrically: thick
ones agree on near-replicas only, thin ones on related texts too, so that the share of agreeing hashes grows
with the overlap of two texts.

Rows: a null text is an empty text; a text without a term of the lexicon is hashed as a whole, so that equal
texts and no others agree; equal ids are ordered by the text's digest, and equal rows are interchangeable; a
null doc_id comes after all others; the only document is its own next document; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, documents, materialize, prepare, text_or_empty

#: Runs of letters, digits and underscores, lower-cased.
TERM = r"[\p{L}\p{N}_]+"
#: The band of ln(N / df). Its upper end bounds the lexicon: terms in at least N / e^7 documents number at most
#: e^7 (about 1,100) times the mean number of distinct terms of a document, whatever N is.
LOW_IDF, HIGH_IDF = 1.0, 7.0
#: Random subsets of the lexicon; the k-th keeps a term with chance 2 ** -LEVELS[k].
LEVELS = (0, 2, 4, 4, 5, 5, 6, 6, 7, 7, 7, 7, 7, 7, 8, 8, 8, 8, 8, 8, 9, 9, 9, 9)
SUBSETS = len(LEVELS)
#: Spark's hash of an empty array: a subset that keeps nothing.
NONE = 42
#: Subsets of such a level are thin; so many in use suffice.
THIN, LEAST_THIN = 7, 4
#: Lexicon entries sent to every task; a larger lexicon is joined by shuffle.
SENT_TERMS = 1_000_000
#: Ranges of ids: documents of one range are ordered in one task.
RANGES_PER_PARTITION = 4


def terms(text: Column) -> Column:
    """Distinct terms of a text as 64-bit codes."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame) -> DataFrame:
    """term, mask: terms of the band and, as bits, the subsets that keep them. All documents count."""
    n = docs.count()
    counts = docs.select(F.explode(terms(text_or_empty())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counts.filter((F.col("df") >= n * math.exp(-HIGH_IDF)) & (F.col("df") <= n * math.exp(-LOW_IDF)))
    mask = F.lit(0).cast("long")
    for k, level in enumerate(LEVELS):
        mask = mask + F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(1 << level)) == 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return materialize(band.select("term", mask.alias("mask")), "lexicon")


def _hashes(kept: str, text: Column) -> Column:
    """One hash for each subset over the sorted distinct terms that it keeps (with their masks); NONE where it keeps none."""
    own = lambda k: F.xxhash64(F.filter(kept, lambda t: t["mask"].bitwiseAND(F.lit(1 << k).cast("long")) != 0))
    whole = F.array(*[F.xxhash64(text, F.lit(-1 - k)) for k in range(SUBSETS)])
    return F.when(F.size(kept) > 0, F.array(*map(own, range(SUBSETS)))).otherwise(whole)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that keep a term of either text.

    Of thin subsets, if enough are in use: they keep a term or two, so that their share estimates the overlap
    of the two texts' terms; thick ones tell near-replicas only.
    """
    both = F.zip_with(a, b, lambda x, y: F.when((x == NONE) & (y == NONE), F.lit(None)).otherwise((x == y).cast("int")))
    used = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    thin = used(F.filter(both, lambda _, i: i >= LEVELS.index(THIN)))
    pick = F.when(F.size(thin) >= LEAST_THIN, thin).otherwise(used(both))
    total, same = F.size(pick), F.size(F.filter(pick, lambda x: x == 1))
    return F.when((total == 0) | (a == b), (a == b).cast("double")).otherwise(same / total)


def as_text(hashes: str) -> Column:
    """The subsets' hashes in their order, 16 hexadecimal digits each."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def ordered(docs: DataFrame) -> DataFrame:
    """key, range, text: documents dealt into ranges of descending id, cut at approximate quantiles."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id"), F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("key"), text_or_empty().alias("text"))
    side = max(2, math.ceil(math.sqrt(RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    shares = [k / (side * side) for k in range(1, side * side)]
    cuts = keyed.agg(F.percentile_approx("key", F.array(*map(F.lit, shares)), F.lit(100 * side * side)).alias("cuts")).first().cuts or [0] * len(shares)
    # Two steps of at most `side` comparisons each: the coarse range, then the fine one in it.
    coarse = F.array(*[F.lit(c).cast("long") for c in cuts[side - 1 :: side]])
    fine = F.array(*[F.array(*[F.lit(c).cast("long") for c in cuts[k * side : k * side + side - 1]]) for k in range(side)])
    below = lambda cut: cut < F.col("key")
    step = F.size(F.filter(coarse, below))
    keyed = keyed.withColumn("step", step)
    return keyed.withColumn("range", -(F.col("step") * side + F.size(F.filter(F.get(fine, F.col("step")), below)))).drop("step")


@contextmanager
def _co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Joins on (range, nth) of sides that are both partitioned by range stay where they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_next(rows: DataFrame, columns: list[str], *by: Column) -> DataFrame:
    """rows with nth and next_<column> of the following row by range and `by`; after the last row the first follows."""
    order = Window.partitionBy("range").orderBy(*by)
    firsts = Window.orderBy("range")
    # The last row of a range is followed by the first of the next range that has any: a row for each range.
    head = rows.withColumn("n", F.row_number().over(order)).filter("n = 1").select("range", *columns)
    head = materialize(head, "range-heads")
    first = {c: F.first(c).over(firsts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in columns}
    after = head.select("range", *[F.coalesce(F.lead(c).over(firsts), first[c]).alias(f"after_{c}") for c in columns])
    led = rows.withColumns({f"lead_{c}": F.lead(c).over(order) for c in columns}).withColumn("nth", F.row_number().over(order))
    return led.join(after, "range").select(
        *[c for c in rows.columns if c != "nth"], "nth", *[F.coalesce(f"lead_{c}", f"after_{c}").alias(f"next_{c}") for c in columns]
    )


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A fingerprint is a string of 16 hexadecimal digits for each random subset of the lexicon.
    """
    prepare(spark)
    words = lexicon(docs)
    small = words.count() <= SENT_TERMS
    rows = ordered(docs).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    # doc_id changes nothing in the order; with it both uses of pairs read the same columns, and one shuffle serves them.
    pairs = with_next(rows, ["text"], F.col("key").desc(), F.col("sha"), F.col("doc_id")).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.expr("left(next_text, cast(floor(n_chars / 2) as int))"))
    pairs = pairs.withColumn("edited", edited)
    about = pairs.select(
        "range", "nth", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.xxhash64("text").alias("code"), F.xxhash64("edited").alias("edited_code"),
    )
    # Exploded rows carry numbers only. A range's documents are in one task already, and so are their terms:
    # gathering them and meeting the rest of the row again needs no shuffle.
    variant = lambda flag, text: F.struct(F.lit(flag).alias("is_edited"), terms(F.col(text)).alias("terms"))
    both = pairs.select("range", "nth", F.explode(F.array(variant(False, "text"), variant(True, "edited"))).alias("v")).select("range", "nth", "v.is_edited", F.explode("v.terms").alias("term"))
    found = both.join(F.broadcast(words) if small else words, "term")
    side = lambda edited: F.array_sort(F.collect_list(F.when(F.col("is_edited") == edited, F.struct("term", "mask"))))
    kept = found.groupBy("range", "nth").agg(side(False).alias("kept"), side(True).alias("edited_kept"))
    none = F.array().cast("array<struct<term:bigint,mask:bigint>>")
    one = about.join(kept, ["range", "nth"], "left").withColumns({c: F.coalesce(c, none) for c in ("kept", "edited_kept")})
    one = one.withColumns({"fingerprint": _hashes("kept", F.col("code")), "edited_fingerprint": _hashes("edited_kept", F.col("edited_code"))})
    with _co_partitioned(spark):
        one = materialize(one.select("range", "nth", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"), "fingerprints")
    out = with_next(one, ["fingerprint"], F.col("nth"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text("fingerprint").alias("fingerprint"), as_text("edited_fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, documents(spark, sf_dir))
