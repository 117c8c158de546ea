"""Exact dedup against immutable snapshots: binary-fuse screening, exact buckets, byte checks.

Rows: a null text is an empty text; texts are equal when their bytes are after lower-casing A-Z; ids and
texts may repeat and each row counts, but of rows that share the group's largest id one stays; a null doc_id
sorts below every other id (it stays only in a group of null ids, keep_id then is null); an empty table gives no rows; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, fresh, materialize, prepare, text_or_empty
from .fuse import FuseFilter
from .screens import sent_filter

#: Digests in one filter; the number of shards follows the snapshot, a shard's size does not.
SHARD_KEYS = 200_000

FILTER = "shard int, seed long, segment long, starts long, payload binary"


@dataclass(frozen=True)
class Snapshot:
    """Distinct digests with the row of the largest id and the row count of each, and a filter for each shard of them."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def normalised(name: str = "text") -> Column:
    return ascii_lower(text_or_empty(name))


def digests(docs: DataFrame, uid: Column, is_new: Column) -> DataFrame:
    return docs.select("doc_id", uid.alias("uid"), is_new.alias("is_new"), F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row a digest; map-side partial sums keep a group of any size to a row for each task."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count(F.lit(1)).alias("n"))


def _shard(shards: int) -> Column:
    return F.conv(F.hex(F.substring("digest", 9, 3)), 16, 10).cast("int") % F.lit(shards)


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x[:8]) for x in column), ">u8").astype(np.uint64)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(_keys(group["digest"]))
    return pd.DataFrame({"shard": group["shard"].iloc[:1], "seed": f.seed, "segment": f.segment, "starts": f.starts, "payload": [f.table]})


def _screen(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if filters.empty or incoming.empty:
        return incoming.iloc[:0].drop(columns="shard")
    f = filters.iloc[0]
    hit = FuseFilter(int(f.seed), int(f.segment), int(f.starts), bytes(f.payload)).contains(_keys(incoming["digest"]))
    return incoming.loc[hit].drop(columns="shard")


def fuse_filters(keys: DataFrame, shards: int) -> DataFrame:
    return keys.select("digest", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(_build, FILTER)


def snapshot(rows: DataFrame) -> Snapshot:
    """Freeze the digests of rows: buckets and filters become tables in the shared folder."""
    buckets = materialize(grouped(rows), "snapshot-buckets")
    shards = 1 + buckets.count() // SHARD_KEYS
    return Snapshot(buckets, materialize(fuse_filters(buckets, shards), "snapshot-filters"), shards)


def screen(batch: DataFrame, frozen: Snapshot) -> DataFrame:
    """The rows of batch (distinct digests) that may be in the snapshot: all that are, and 1 in 256 others.

    A batch that is large beside the snapshot is salted, and each shard's filter goes to all of its salts.
    """
    salts = 1 + batch.count() // (SHARD_KEYS * frozen.shards)
    rows = batch.withColumn("shard", _shard(frozen.shards) * salts + F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int"))
    filters = frozen.filters.withColumn("shard", F.explode(F.sequence(F.col("shard") * salts, F.col("shard") * salts + (salts - 1))))
    return rows.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_screen, batch.schema)


def merged(frozen: Snapshot, batch: DataFrame) -> DataFrame:
    """Groups of the snapshot and the batch together: only screened digests meet the snapshot's buckets.

    A filter over the screened digests, while it is small, keeps the rest of the snapshot, and of the batch, where
    it is: neither is shuffled but for rows that may meet.
    """
    positive = materialize(screen(batch, frozen).select("digest", F.col("keep").alias("new_keep"), F.col("n").alias("new_n")), "positives")
    may_hold = sent_filter(positive.select(F.xxhash64("digest").alias("k")))

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows that may be among the positives, and the others."""
        if may_hold is None:
            return rows, None
        marked = rows.withColumn("may", may_hold(F.xxhash64("digest")))
        return marked.filter("may").drop("may"), marked.filter("NOT may").drop("may")

    met, apart = parted(frozen.buckets)
    known = met.join(positive, "digest", "left").select("digest", F.greatest("keep", "new_keep").alias("keep"), (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("n"))
    both = met.join(positive, "digest", "left_semi").select("digest")
    screened, unseen = parted(batch.select("digest", "keep", "n"))
    parts = [known, screened.join(both, "digest", "left_anti"), *(x for x in (apart, unseen) if x is not None)]
    return reduce(DataFrame.unionByName, parts)


def byte_checked(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests of groups of two rows and more, with the number of byte-different texts behind each.

    The group's texts meet as grouping keys, so equality is that of all bytes and copies within a task
    collapse before the shuffle. Other documents are screened out by a filter over the groups' digests
    while that filter is small; a larger one is not sent, and the semi join alone drops them.
    """
    repeated = groups.filter("n > 1").select("digest")
    texts = docs.select(F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest"), normalised().alias("norm"))
    if may_hold := sent_filter(repeated.select(F.xxhash64("digest").alias("k"))):
        texts = texts.filter(may_hold(F.xxhash64("digest")))
    texts = texts.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows"))
    return texts.join(repeated, "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("variants"), F.sum("rows").alias("checked"))


def exact_dedup(spark: SparkSession, docs: DataFrame, is_new: Column | None = None, uid: Column | None = None) -> DataFrame:
    """uid, doc_id, keep_id, group_size, kept, text_sha256 for every row of docs; uid tells rows apart.

    is_new says which rows arrive as the batch; the others are frozen as the snapshot first. By default a
    hash of the id deals rows into the two, which changes nothing in the result.
    """
    prepare(spark)
    is_new = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1 if is_new is None else is_new
    rows = materialize(digests(docs, F.monotonically_increasing_id() if uid is None else uid, is_new), "digests")
    frozen = snapshot(rows.filter(~F.col("is_new")))
    groups = materialize(merged(frozen, materialize(grouped(rows.filter("is_new")), "batch-groups")).filter("n > 1"), "groups")
    checked = byte_checked(docs, groups)
    sound = (F.col("variants") == 1) & (F.col("checked") == F.col("n"))
    repeated = materialize(
        groups.filter("n > 1").join(checked, "digest", "left").select(
            "digest", "keep", F.when(sound, F.col("n")).otherwise(F.raise_error(F.lit("equal digests of different texts"))).cast("long").alias("n")
        ),
        "checked-groups",
    )
    alone = F.col("n").isNull()
    return rows.join(repeated, "digest", "left").select(
        "uid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep.uid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    uid = fresh(docs, "uid")
    stored = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "dedup-input")
    dropped = exact_dedup(spark, stored, uid=F.col(uid)).filter(~F.col("kept")).select(F.col("uid").alias(uid))
    return stored.join(dropped, uid, "left_anti").select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, documents(spark, sf_dir)).drop("uid")


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT doc_id, sha256(x) AS text_sha256, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
  row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) AS r FROM t)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM g
"""
