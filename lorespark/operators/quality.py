"""Splits, balance, licences, integrity and audits of a corpus.

Null keys count as violations, null texts as unusable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .windows import USABLE_WORDS

#: Licences that allow training.
TRAINING_LICENCES = ("CC-BY-4.0", "CC-BY-SA-4.0", "OGL-AU", "PUBLIC-DOMAIN")
#: Words of a source that go into the training text at most.
SOURCE_WORDS = 6_000
#: What the balance says of a source.
WHOLE, CAPPED, UNCLEAR = "included in full", "capped at {:,} words", "licence is unclear or incompatible with training"


def usable(text: str) -> Column:
    return F.coalesce((T.word_count(text) >= USABLE_WORDS) & (F.trim(text) != ""), F.lit(False))


def splits(documents: DataFrame, key: str) -> DataFrame:
    """key, split: by order of the key's SHA-256, 80 % train, 10 % validation, the rest test.

    Ranks are exact and made of ranks within 4096 hash ranges and the counts before them, so that no task
    orders all documents.
    """
    h = F.sha2(F.col(key).cast("string"), 256)
    rows = documents.select(key, h.alias("_h")).withColumn("_range", F.substring("_h", 1, 3))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4096 rows
    counts = counts.select("_range", before.alias("_before"), F.sum("m").over(Window.partitionBy()).alias("n"))
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))).join(counts, "_range")
    n, rank = F.col("n"), F.col("_in") + F.col("_before")
    train = F.greatest(F.lit(1), F.bround(0.8 * n).cast("long"))
    held = F.when(n >= 3, F.greatest(F.lit(1), F.bround(0.1 * n).cast("long"))).otherwise(F.lit(0))
    train = F.when((n >= 3) & (train + held >= n), n - held - 1).otherwise(train)
    return ranked.select(key, F.when(rank <= train, "train").when(rank <= train + held, "validation").otherwise("test").alias("split"))


def capped_text(text: str, cap: int) -> Column:
    """The text, trimmed; one of more than cap words ends with its cap-th word, spacing kept."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"(?s).*?{T.WORD}"), F.lit(0))
    whole = F.when(F.size(pieces) > cap, F.array_join(F.slice(pieces, 1, cap), "")).otherwise(F.col(text))
    return F.regexp_replace(whole, r"^\s+|\s+$", "")


def source_balance(rows: DataFrame, cap: int = SOURCE_WORDS, licences: tuple[str, ...] = TRAINING_LICENCES) -> DataFrame:
    """Words before and after licence filter and cap, with shares, of rows (source_id, licence, words)."""
    ok = F.coalesce(F.col("licence").isin(*licences), F.lit(False))
    after = F.when(ok, F.least("words", F.lit(cap))).otherwise(F.lit(0))
    everything = Window.partitionBy()
    rows = rows.select("source_id", "licence", ok.alias("training_eligible"), F.col("words").alias("words_before"), after.cast("long").alias("words_after"))
    share = lambda c: F.round(F.coalesce(F.try_divide(100.0 * F.col(c), F.sum(c).over(everything)), F.lit(0.0)), 2)
    decision = F.when(~F.col("training_eligible"), UNCLEAR).when(F.col("words_before") > cap, CAPPED.format(cap)).otherwise(WHOLE)
    return rows.withColumns({"percent_before": share("words_before"), "percent_after": share("words_after"), "decision": decision})


def licence_audit(rows: DataFrame, licences: tuple[str, ...] = TRAINING_LICENCES) -> DataFrame:
    """decision for rows (source_id, licence, usable)."""
    ok = F.coalesce(F.col("licence").isin(*licences), F.lit(False))
    return rows.withColumn("decision", F.when(~F.col("usable"), "exclude_unusable").when(~ok, "exclude_licence").otherwise("include"))


def duplicate_ids(rows: DataFrame, key: str, rule: str) -> DataFrame:
    bad = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1))
    return bad.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str, rule: str, own: str) -> DataFrame:
    """Rows whose column, or any entry of it, is no key of parents."""
    kind = dict(rows.dtypes)[column]
    ref = rows.select(F.col(own).cast("string").alias("id"), (F.explode(column) if kind.startswith("array") else F.col(column)).alias("_ref"))
    return ref.join(parents.select(F.col(key).alias("_ref")), "_ref", "left_anti").select(F.lit(rule).alias("rule"), "id").distinct()


def failing(rows: DataFrame, own: str, ok: Column, rule: str) -> DataFrame:
    return rows.filter(~F.coalesce(ok, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(own).cast("string").alias("id"))


def violations(*parts: DataFrame) -> DataFrame:
    """One table of (rule, id); an empty one means that the corpus is sound."""
    return reduce(DataFrame.unionByName, parts)


def require_sound(found: DataFrame) -> None:
    if first := found.limit(1).collect():
        raise ValueError(f"{first[0].rule}: {first[0].id}")


def duplicate_names(entities: DataFrame, places: tuple[str, ...] = ()) -> DataFrame:
    """name_a, name_b of different names with one key; pairs only within a key of few names."""
    named = entities.select("name", T.duplicate_name_key("name", places).alias("key")).filter("key IS NOT NULL").distinct()
    return named.alias("a").join(named.alias("b"), F.expr("a.key = b.key AND a.name < b.name")).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()])


def corpus_fingerprint(rows: DataFrame) -> DataFrame:
    """Identity of each source and its content, without content."""
    return rows.select("source_id", "source_url", "licence", "retrieval_timestamp", F.octet_length("content").cast("long").alias("file_size"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), "collection_status")
