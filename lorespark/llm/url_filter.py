"""URL filters as a temporal list join.

A list is a table of dated entries: from `since` on, `pattern` has `action` (block or allow) until the next
entry of the same pattern. Entries become validity intervals once, and an as-of join meets every capture with
the entries active when it was fetched. A pattern is a host (without user info, port and dots at its end) with all its subdomains, or a host and a path
prefix that ends in a slash; of the active entries the one of the longest pattern decides.

Rows: a null url, or one without a host, matches nothing; a null time of fetching matches nothing; entries of a
null pattern, time or action are ignored; of entries of one pattern and time block wins; repeated captures are
judged each; empty tables give no rows, and an empty list action `none` everywhere; columns of captures other
than those named are ignored. Times are seconds since 1970.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare

DAY = 86_400
#: 2024-01-01.
START = 1_704_067_200
#: Scheme, user info if any, and the host: a bracketed address, or a name up to its port and without dots at its end.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]*[^/?#:@\[\].])"


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, since, until (null: still valid), repeated states folded into one interval."""
    entries = entries.filter("pattern IS NOT NULL AND since IS NOT NULL AND action IS NOT NULL")
    one = entries.groupBy("pattern", "since").agg(F.max("action").alias("action"))  # block > allow
    by_time = Window.partitionBy("pattern").orderBy("since")
    changes = one.withColumn("last", F.lag("action").over(by_time)).filter("last IS NULL OR last <> action")
    return changes.select("pattern", "action", "since", F.lead("since").over(by_time).alias("until"))


def with_keys(captures: DataFrame) -> DataFrame:
    """captures with host and keys: every pattern that could match the url."""
    host = F.lower(F.regexp_extract("url", HOST, 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    rows = captures.withColumns({"host": F.coalesce(host, F.lit("")), "_dirs": F.split(F.coalesce(path, F.lit("")), "/"), "_labels": F.split(F.coalesce(host, F.lit("")), r"\.")})
    n, m = F.size("_labels"), F.size("_dirs")
    hosts = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice("_labels", i, n), ".")))
    dirs = F.when(m >= 3, F.transform(F.sequence(F.lit(2), F.greatest(m - 1, F.lit(2))), lambda i: F.concat("host", F.array_join(F.slice("_dirs", F.lit(1), i), "/"), F.lit("/"))))
    none = F.array().cast("array<string>")
    return rows.withColumn("keys", F.when(F.col("host") != "", F.concat(F.coalesce(hosts, none), F.coalesce(dirs, none))).otherwise(none)).drop("_dirs", "_labels")


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, n_active, pattern, action, blocked for every capture (page_id, url, fetched_at)."""
    prepare(captures.sparkSession)
    rows = with_keys(captures.select("page_id", "url", "fetched_at", F.monotonically_increasing_id().alias("uid")))
    rows = materialize(rows, "captures")
    valid = intervals(entries)
    keyed = rows.filter("fetched_at IS NOT NULL").select("uid", "fetched_at", F.explode("keys").alias("pattern"))
    active = keyed.join(valid, "pattern").filter("since <= fetched_at AND (until IS NULL OR fetched_at < until)")
    best = active.groupBy("uid").agg(F.count(F.lit(1)).alias("n_active"), F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action")).alias("best"))
    out = rows.join(best, "uid", "left")
    action = F.coalesce(F.col("best.action"), F.lit("none"))
    return out.select("page_id", "url", "fetched_at", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("best.pattern").alias("pattern"), action.alias("action"), (action == "block").alias("blocked"))


def synthetic_times(pages: DataFrame) -> DataFrame:
    """The test tables have no times of fetching; a year of them follows from page_id."""
    second = F.pmod(F.col("page_id"), F.lit(365)) * DAY + F.pmod(F.col("page_id") * 7919, F.lit(DAY))
    return pages.select("page_id", "url", (F.lit(START) + second).cast("long").alias("fetched_at"))


def synthetic_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for hosts and paths of the table, by digits of their MD5: blocks, pardons and blocks again."""
    keyed = with_keys(pages.select("url"))
    pattern = keyed.select(F.explode("keys").alias("pattern")).distinct()
    digits = lambda at, n: F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), at, n), 16, 10).cast("long")
    first, parts = digits(1, 6), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("action")) for k, a in enumerate(("block", "allow", "block"))])
    listed = pattern.withColumn("at", first).filter("at % 3 = 0").withColumn("part", F.explode(parts))
    since = F.lit(START) + F.pmod(F.col("at"), F.lit(120)) * DAY + F.col("part.k") * 110 * DAY
    return listed.select("pattern", since.cast("long").alias("since"), "part.action")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filtered(synthetic_times(pages), synthetic_entries(pages))


ORACLE = r"""
WITH c AS (SELECT page_id, url, (1704067200 + page_id % 365 * 86400 + page_id * 7919 % 86400)::BIGINT AS fetched_at, row_number() OVER () AS uid,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS dirs FROM c WHERE host <> ''),
k AS (SELECT uid, fetched_at, unnest(list_concat(list_transform(range(1, len(labels)), lambda i: array_to_string(labels[i:], '.')),
  list_transform(range(2, len(dirs)), lambda i: host || array_to_string(dirs[1:i], '/') || '/'))) AS pattern FROM p),
n AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS dg FROM (SELECT DISTINCT pattern FROM k)),
e AS (SELECT pattern, action, 1704067200 + dg % 120 * 86400 + o * 110 * 86400 AS since FROM n, (VALUES (0, 'block'), (1, 'allow'), (2, 'block')) v(o, action) WHERE dg % 3 = 0),
i AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS till FROM e),
m AS (SELECT uid, count(*) AS n_active, max({'n': length(i.pattern), 'pattern': i.pattern, 'action': action}) AS b FROM k JOIN i ON k.pattern = i.pattern AND since <= fetched_at AND (till IS NULL OR fetched_at < till) GROUP BY uid)
SELECT page_id, url, fetched_at, coalesce(n_active, 0) AS n_active, b.pattern AS pattern, coalesce(b.action, 'none') AS action, coalesce(b.action, 'none') = 'block' AS blocked FROM c LEFT JOIN m USING (uid)
"""
