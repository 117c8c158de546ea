"""Evaluation of rankings, calibrated abstention, and evidence filters.

A question without any result has top score 0; its ranked list is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counting as N
from .lookup import held_names, overlapping


def containment(passages: DataFrame, queries: DataFrame, p: tuple[str, str], q: tuple[str, str]) -> DataFrame:
    """query_id, id where the passage holds the question's whole text.

    Both sides meet by a question's longest word with what stands around it trimmed to letters: an equi-join on
    words that some question chose, then the exact check. Questions without a word are checked by their text.
    """
    asked = queries.select(F.col(q[0]).alias("query_id"), F.col(q[1]).alias("_q")).filter("_q <> ''")
    # First and last words of a question may be parts of longer words in a passage; inner ones are not.
    asked = N.inner_words(asked, "query_id", "_q")
    rows = passages.select(F.col(p[0]).alias("id"), F.col(p[1]).alias("_t"))
    # Both sides are cut into words by the same rule; the bitmap spares other words a row.
    keyed = N.counted(rows, "id", F.col("_t"), N.words, N.asked_bits(N.term_bucket("word"), asked.filter("word <> ''"))).select("id", F.col("term").alias("word"))
    chosen = keyed.join(asked.filter("word <> ''").select("query_id", "word"), "word").select("query_id", "id")
    rest = asked.filter("word = ''")
    hits = chosen.join(asked.select("query_id", "_q"), "query_id").join(rows, "id").filter(F.col("_t").contains(F.col("_q"))).select("query_id", "id")
    few = rows.join(rest, F.col("_t").contains(F.col("_q"))).select("query_id", "id")
    return hits.unionByName(few)


def traces(ranked: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, top_score, ranked (ids by rank), gold (ids), answerable for every question."""
    per = ranked.groupBy("query_id").agg(F.max(F.round("score", 9)).alias("top_score"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ranked"))
    want = gold.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("gold"))
    rows = queries.join(per, "query_id", "left").join(want, "query_id", "left")
    none = F.array().cast(rows.schema["ranked"].dataType)
    return rows.select("query_id", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("ranked", none).alias("ranked"), F.coalesce("gold", none).alias("gold"), F.col("gold").isNotNull().alias("answerable"))


def abstention_threshold(rows: DataFrame) -> DataFrame:
    """threshold, quality: the lowest of {0} and the scores that maximises the mean of accept and reject rates.

    Sorted running counts replace trying each candidate on all rows.
    """
    per = rows.groupBy("top_score").agg(F.count_if("answerable").alias("a"), F.count_if(~F.col("answerable")).alias("u"))
    spark = rows.sparkSession
    per = per.unionByName(spark.createDataFrame([(0.0, 0, 0)], "top_score double, a long, u long")).groupBy("top_score").agg(F.sum("a").alias("a"), F.sum("u").alias("u"))
    from pyspark.sql import Window

    below = Window.orderBy("top_score").rowsBetween(Window.unboundedPreceding, -1)  # a row for each distinct score
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    accept = F.coalesce(F.try_divide(F.sum("a").over(all_) - F.coalesce(F.sum("a").over(below), F.lit(0)), F.sum("a").over(all_)), F.lit(1.0))
    reject = F.coalesce(F.try_divide(F.coalesce(F.sum("u").over(below), F.lit(0)), F.sum("u").over(all_)), F.lit(1.0))
    swept = per.select(F.col("top_score").alias("threshold"), ((accept + reject) / 2).alias("quality"))
    best = swept.agg(F.max(F.struct(F.round("quality", 9).alias("r"), (-F.col("threshold")).alias("t"), "quality")).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), F.col("b.quality").alias("quality"))


def metrics(rows: DataFrame) -> DataFrame:
    """One row of hit rates, MRR, nDCG and answerability over traces with abstained."""
    ranks = F.filter(F.transform("ranked", lambda x, i: F.when(F.array_contains(F.col("gold"), x), i + 1)), lambda r: r.isNotNull())
    gain = lambda r: 1 / F.log2(r + 1.0)
    total = lambda rs: F.aggregate(rs, F.lit(0.0), lambda s, r: s + gain(r))
    ideal = total(F.sequence(F.lit(1), F.greatest(F.least(F.size("gold"), F.lit(10)), F.lit(1))))
    rows = rows.withColumn("_r", ranks).withColumn("_first", F.coalesce(F.array_min("_r"), F.lit(99)))
    rows = rows.withColumns({"_rr": F.when(F.col("_first") < 99, 1.0 / F.col("_first")).otherwise(0.0), "_ndcg": total(F.filter("_r", lambda r: r <= 10)) / ideal})
    mean = lambda c: F.round(F.avg(F.when(F.col("answerable"), c)), 6)
    both = F.count_if(F.col("abstained") & ~F.col("answerable"))
    rate = lambda n: F.round(F.coalesce(F.try_divide(both, n), F.lit(0.0)), 6)
    return rows.agg(
        F.count(F.lit(1)).alias("query_count"), *[mean((F.col("_first") <= k).cast("int")).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)], mean(F.col("_rr")).alias("mrr"), mean(F.col("_ndcg")).alias("ndcg_at_10"),
        rate(F.count_if("abstained")).alias("unanswerable_precision"), rate(F.count_if(~F.col("answerable"))).alias("unanswerable_recall"), F.round(F.avg(F.col("abstained").cast("int")), 6).alias("zero_result_rate"),
    )


def success() -> Column:
    hit = F.arrays_overlap("gold", F.slice("ranked", 1, 5))
    return F.when(F.col("answerable"), ~F.col("abstained") & hit).otherwise(F.col("abstained"))


def failure_category(kind: str = "query_type") -> Column:
    """Why a question failed, by the first rule that applies; the labels are fixed values."""
    has = lambda *xs: F.col(kind).rlike("|".join(xs))
    return (
        F.when(~F.col("answerable"), F.when(F.col("abstained"), "none").otherwise("insufficient_corpus_coverage"))
        .when(has("alias"), "alias_mismatch").when(has("temporal", "date"), "date_filter_failure")
        .when(has("geographic", "location"), "location_ambiguity").when(F.col("has_entities"), "semantic_confusion").otherwise("lexical_mismatch")
    )


def answered(trace: DataFrame, limit: DataFrame, evidence_k: int = 5) -> DataFrame:
    """trace with abstained, evidence (three to five ids, none if abstained) and a badge."""
    k = min(5, max(3, evidence_k))
    rows = trace.join(F.broadcast(limit)).withColumn("abstained", F.col("top_score") < F.col("threshold"))  # one row of limit
    badge = F.when(F.col("top_score") >= 2 * F.col("threshold"), "High").when(F.col("top_score") >= F.col("threshold"), "Moderate").otherwise("Below threshold")
    return rows.withColumns({"evidence": F.when(F.col("abstained"), F.slice("ranked", 1, 0)).otherwise(F.slice("ranked", 1, k)), "badge": badge})


def compare(runs: dict[str, DataFrame], gold: DataFrame, queries: DataFrame) -> DataFrame:
    """method, recall_at_5, mrr, ndcg_at_10, is_best over answerable questions; ties in MRR go to the later name."""
    out = None
    for name, ranked in runs.items():
        t = traces(ranked, gold, queries).filter("answerable").withColumn("abstained", F.lit(False))
        row = metrics(t).select(F.lit(name).alias("method"), "recall_at_5", "mrr", "ndcg_at_10")
        out = row if out is None else out.unionByName(row)
    best = out.agg(F.max_by("method", F.struct("mrr", "method")).alias("best"))
    return out.join(F.broadcast(best)).select("method", "recall_at_5", "mrr", "ndcg_at_10", (F.col("method") == F.col("best")).alias("is_best"))  # one row of best


def in_date_range(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (id, type, start_year, end_year) by overlap with ranges (query_id, type, low, high); a null type is any."""
    met = overlapping(rows.filter("start_year IS NOT NULL"), ranges.withColumnRenamed("type", "want"))
    return met.filter(F.col("want").isNull() | (F.col("want") == F.col("type")))


def in_place(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, id of places (id, name, suburb, address) that hold the wanted text, whatever the case."""
    fields = places.select("id", F.posexplode(F.array("name", "suburb", "address")).alias("n", "text"))
    held = held_names(fields.select(F.struct("id", "n").alias("text_id"), "text"), wanted.select(F.col("query_id").alias("name_id"), F.col("place").alias("name")))
    return held.select(F.col("name_id").alias("query_id"), F.col("text_id.id").alias("id")).distinct()
