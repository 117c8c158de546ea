"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times it should be taken. Of all rates up to CAP that meet each source's
token target, those closest to one in relative entropy (every document weighs the same) are exponentially tilted:
rate = min(CAP, exp(lam * size / mean size)), with one dual variable lam for a source. So a source short of its
target repeats its long documents first, and one beyond it leaves them out first. The dual is convex; Newton's
iterations solve it on distributed sums over the histogram of sizes, a job for each iteration, all sources at once,
each kept between bounds that hold its solution.

Rates become copies: the whole part goes to every document; of the fractions, documents are taken in the order of
hash / fraction (sequential Poisson sampling) while they fit into what is left of the target, then the largest that
still fits, and so on with those that fit, until no document of any source does.

Rows: a null text has size 0 and takes nothing; a null source is a source of its own and comes last; repeated
rows each count, and equal rows are interchangeable; a null doc_id hashes as empty text; ties in the order go by
hash and size; an empty table gives no rows; columns other than doc_id, source and text are ignored, or kept by
mixed() with one row for each copy.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop, fresh, materialize, text_or_empty

WEIGHTS = (1, 2, 3)
CAP = 3
#: Newton's iterations at most, and the relative error of a source's tokens at which they end.
NEWTON_STEPS, ERROR = 60, 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def _same() -> Column:
    """Rows a and b are of one source."""
    return F.expr("a.source <=> b.source")


def order_key(name: str = "doc_id") -> Column:
    return F.sha2(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"), 256)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: each source's share of all words, stopped at CAP times its own.

    Sources fill in order of the level at which they reach their cap; the first that does not reach it fixes
    the level of all that follow, which is what resharing the excess by weight converges to.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (k + 1).cast("int")).cast("double")
    rows = per_source.withColumn("weight", weight).withColumn("most", (CAP * F.col("source_size")).cast("double"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_level), F.lit(0.0))
    rows = rows.withColumns({"rest": F.sum("source_size").over(everything) - before("most"), "weights": F.sum("weight").over(everything) - before("weight")})
    rows = rows.withColumn("level", F.col("rest") / F.col("weights")).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)  # later rows only subtract more from it
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", level * F.col("weight"))))
    return rows.select("source", "source_size", "target")


def rate(lam: Column, size: Column, mean: Column) -> Column:
    return F.least(F.exp(F.least(lam * size / mean, F.lit(math.log(CAP)))), F.lit(float(CAP)))


def duals(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, source_size, target, mean, lam (null where a source has no words): the balance's dual variables."""
    words = materialize(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    mean = words.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = plan.alias("a").join(mean.alias("b"), _same(), "left").select("a.*", "b.mean")
    # A rate of the shortest text bounds all of its source's: with size 1, exp(lam / mean).
    share = F.log(F.try_divide("target", "source_size"))
    state = state.withColumns({"lam": share, "low": F.least(F.lit(0.0), share) * F.col("mean"), "high": math.log(CAP) * F.col("mean")})
    state = state.withColumn("lam", F.when(F.col("mean").isNull() | (F.col("target") <= 0), F.lit(None)).when(F.col("target") >= CAP * F.col("source_size"), F.col("high")).otherwise(F.col("lam")))
    state = materialize(state.withColumn("was", F.lit(float("inf"))), "duals")
    tokens = F.col("a.n") * F.col("a.size") * rate(F.col("b.lam"), F.col("a.size"), F.col("b.mean"))
    below = F.col("b.lam") * F.col("a.size") / F.col("b.mean") < math.log(CAP)
    slope = F.when(below, tokens * F.col("a.size") / F.col("b.mean")).otherwise(0.0)
    for _ in range(NEWTON_STEPS):
        sums = words.alias("a").join(state.alias("b"), _same()).groupBy("b.source").agg(F.sum(tokens).alias("tokens"), F.sum(slope).alias("slope"))
        now = state.alias("a").join(sums.alias("b"), _same(), "left").select("a.*", "b.tokens", "b.slope")
        over = F.col("tokens") - F.col("target")
        right = F.abs(over) <= ERROR * F.col("target")
        now = now.withColumns({"low": F.when(over < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(over > 0, F.col("lam")).otherwise(F.col("high")), "next": F.col("lam") - F.try_divide(over, F.col("slope"))})
        # A step that leaves the bounds, or comes after one that did not halve the error, goes to their middle instead.
        good = (F.col("next") > F.col("low")) & (F.col("next") < F.col("high")) & (F.abs(over) < F.col("was") / 2)
        now = now.withColumn("lam", F.when(right | F.col("tokens").isNull(), F.col("lam")).when(good, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2))
        now = materialize(now.withColumns({"right": F.coalesce(right, F.lit(True)), "was": F.abs(over)}).drop("tokens", "slope", "next"), "duals")
        drop(state)
        state = now.drop("right")
        if now.filter("NOT right").isEmpty():
            break
    drop(words)
    return state.drop("low", "high", "was")


def _upto(rows: DataFrame) -> DataFrame:
    """rows with upto, the running sum of size in the order of key within the source.

    Salts grow with the key, so sums over them are offsets of running sums within them and a source of any size is
    summed in up to 4096 parts.
    """
    salted = rows.withColumn("salt", F.floor(F.lit(4096) * F.col("key") / (1 + F.col("key"))).cast("int"))
    parts = salted.groupBy("source", "salt").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("source", "salt", before.alias("before"))
    run = F.sum("size").over(Window.partitionBy("source", "salt").orderBy("key", "h", "size", "uid").rowsBetween(Window.unboundedPreceding, 0))
    joined = salted.withColumn("run", run).alias("a").join(parts.alias("b"), F.expr("a.source <=> b.source AND a.salt = b.salt"))
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("run") + F.col("before")).alias("upto"))


def _rounded(rows: DataFrame, left: DataFrame) -> DataFrame | None:
    """uid of the rows (uid, source, size, key, h) to take once more, given what is left of each source's target.

    Each round takes the documents that fit, in order, as far as they fit together, then the largest that still
    does: what is left is more than halved in two rounds, so rounds grow with the logarithm of the words left.
    """
    fits = _same() & F.expr("a.size <= b.left")
    pool, taken = rows, []
    while True:
        pool = materialize(pool.alias("a").join(left.alias("b"), fits).select("a.*", "b.left"), "fitting")
        if pool.isEmpty():
            break
        pool = materialize(_upto(pool).withColumn("take", F.col("upto") <= F.col("left")).drop("upto"), "round")
        for last in (False, True):
            got = F.coalesce(F.sum(F.when(F.col("take"), F.col("size"))), F.lit(0))
            left = pool.groupBy("source", "left").agg(got.alias("got")).select("source", (F.col("left") - F.col("got")).alias("left"))
            if last:
                break
            best = pool.drop("left").filter("NOT take").alias("a").join(left.alias("b"), fits).groupBy("a.source").agg(F.max(F.struct("a.size", "a.h", "a.uid")).alias("best"))
            best = best.select(F.col("best.uid").alias("uid"), F.lit(True).alias("best"))
            pool = materialize(pool.join(best, "uid", "left").withColumn("take", F.col("take") | F.coalesce("best", F.lit(False))).drop("best"), "best")
        taken.append(pool.filter("take").select("uid"))
        pool = pool.filter("NOT take").drop("left", "take")
    return reduce(DataFrame.unionAll, taken) if taken else None


def copies(docs: DataFrame, uid: Column | None = None) -> DataFrame:
    """uid, doc_id, source, size, source_size, target, rate, copies for each row of docs; uid tells rows apart."""
    sizes = materialize(
        docs.select((F.monotonically_increasing_id() if uid is None else uid).alias("uid"), "doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), order_key().alias("h")),
        "sizes",
    )
    plan = duals(sizes, materialize(targets(sizes), "targets"))
    rows = sizes.alias("a").join(plan.alias("b"), _same()).select(
        "a.*", "b.source_size", "b.target", F.when(F.col("a.size") > 0, F.coalesce(rate(F.col("b.lam"), F.col("a.size"), F.col("b.mean")), F.lit(0.0))).otherwise(0.0).alias("rate")
    )
    whole = F.floor(F.col("rate") + 1e-9)
    chance = F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / float(1 << 52)
    rows = rows.withColumn("whole", whole).withColumn("key", chance / F.greatest(F.col("rate") - F.col("whole"), F.lit(1e-9)))
    rows = materialize(rows, "rates")
    left = rows.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("whole")).alias("got")).select("source", (F.col("target") - F.col("got") + 1e-6).alias("left"))
    picks = _rounded(rows.filter((F.col("size") > 0) & (F.col("whole") < CAP)).select("uid", "source", "size", "key", "h"), left)
    times = F.col("whole")
    if picks is not None:
        rows = rows.join(picks.withColumn("more", F.lit(1)), "uid", "left")
        times = times + F.coalesce("more", F.lit(0))
    return rows.select("uid", "doc_id", "source", "size", "source_size", "target", "rate", times.cast("long").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as its copies say; rows of no copy are left out. Columns stay those of docs."""
    uid, times, nth = fresh(docs, "uid"), fresh(docs, "times"), fresh(docs, "nth")
    kept = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "mix-input")
    many = copies(kept, F.col(uid)).filter("copies > 0").select(F.col("uid").alias(uid), F.col("copies").cast("int").alias(times))
    return kept.join(many, uid).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
