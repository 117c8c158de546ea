"""Collection: source registry, status machine, raw records and their checks, sinks.

Fetching itself is an interface (Fetcher): given rows of sources it yields payloads. Everything after it is a
DataFrame transformation over payload rows.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import prepare

#: A body of fewer UTF-8 bytes is a failure.
LEAST_BYTES = 100
#: Seconds between requests to one host.
POLITE_S = 2.0
ATTEMPTS, BACKOFF_S, TIMEOUT_S = 3, 4.0, 20.0

SOURCE = "source_id string, name string, url string, source_type string, expected_topic string, licence string, licence_url string, enabled boolean, notes string"
PAYLOAD = "source_id string, http_status int, content_type string, body binary, error string"


class Fetcher(ABC):
    """Fetches one url: (status, body, content type). Raises on failure."""

    @abstractmethod
    def fetch(self, url: str) -> tuple[int, bytes, str]: ...


def fetched(sources: DataFrame, fetcher: Fetcher, sleep: float = BACKOFF_S) -> DataFrame:
    """Payload rows; a host's sources are in one task, one after the other, each tried up to ATTEMPTS times."""
    prepare(sources.sparkSession)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for part in parts:
            rows = []
            for source_id, url in zip(part["source_id"], part["url"], strict=True):
                row = (source_id, None, None, None, "no attempt")
                for attempt in range(ATTEMPTS):
                    try:
                        status, body, kind = fetcher.fetch(url)
                        row = (source_id, status, kind, body, None)
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a fetch is a row
                        row = (source_id, None, None, None, str(e))
                        time.sleep(sleep * (attempt + 1) if attempt + 1 < ATTEMPTS else 0)
                rows.append(row)
            yield pd.DataFrame(rows, columns=["source_id", "http_status", "content_type", "body", "error"])

    by_host = sources.withColumn("_host", F.parse_url("url", F.lit("HOST"))).repartition("_host").sortWithinPartitions("_host")
    return by_host.select("source_id", "url").mapInPandas(work, PAYLOAD)


def enabled(sources: DataFrame) -> DataFrame:
    """Sources are enabled unless they say otherwise."""
    return sources.filter(F.coalesce("enabled", F.lit(True)))


def duplicate_urls(sources: DataFrame, order: str) -> DataFrame:
    """order, url, first_id, is_duplicate: the first of each url wins."""
    w = Window.partitionBy("url").orderBy(order)
    return sources.select(order, "url", F.first(order).over(w).alias("first_id"), (F.row_number().over(w) > 1).alias("is_duplicate"))


def _steps(collected: str, allowed: str, http_status: str, body: str) -> list[tuple[Column, str, Column]]:
    return [
        (F.col(collected), "skipped", F.lit("already collected")),
        (~F.col(allowed), "failed", F.lit("robots disallowed")),
        (F.col(http_status).isNull(), "failed", F.lit("fetch failed")),
        (F.col(http_status) >= 400, "failed", F.concat(F.lit("HTTP "), F.col(http_status).cast("string"))),
        (F.coalesce(F.octet_length(body), F.lit(0)) < LEAST_BYTES, "failed", F.lit("body too small")),
    ]


def status(collected: str, allowed: str, http_status: str, body: str) -> Column:
    """The first of the ordered outcomes that applies, else ok."""
    out = F.lit("ok")
    for when, name, _ in reversed(_steps(collected, allowed, http_status, body)):
        out = F.when(when, name).otherwise(out)
    return out


def reason(collected: str, allowed: str, http_status: str, body: str) -> Column:
    out = F.lit(None).cast("string")
    for when, _, why in reversed(_steps(collected, allowed, http_status, body)):
        out = F.when(when, why).otherwise(out)
    return out


def new_sources(sources: DataFrame, bronze: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources without a row in the bronze table."""
    return sources.join(bronze.select(key), key, "left_anti")


def schedule(sources: DataFrame, host: str, order: str, gap: float = POLITE_S) -> DataFrame:
    """When, in seconds from the start, each request may begin."""
    nth = F.row_number().over(Window.partitionBy(host).orderBy(order)) - 1
    return sources.select(order, host, (nth * gap).alias("start_after_s"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """host, prefix of every Disallow line for all agents, from robots.txt rows (host, body)."""
    line = robots.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line"))
    agent = F.last(F.when(F.lower("line").startswith("user-agent:"), F.trim(F.regexp_replace("line", "^[^:]*:", ""))), ignorenulls=True).over(Window.partitionBy("host").orderBy("n"))
    rules = line.withColumn("agent", agent).filter((F.col("agent") == "*") & F.lower("line").startswith("disallow:"))
    return rules.select("host", F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("prefix")).filter("prefix <> ''")


def robots_allowed(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """sources with allowed: no rule of the host is a prefix of the path; hosts without rules allow all."""
    rows = sources.withColumns({"host": F.parse_url("url", F.lit("HOST")), "_path": F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("/"))})
    per = rules.groupBy("host").agg(F.collect_set("prefix").alias("_prefixes"))
    hit = F.exists(F.coalesce("_prefixes", F.array().cast("array<string>")), lambda p: F.col("_path").startswith(p))
    return rows.join(per, "host", "left").withColumn("allowed", ~hit).drop("_path", "_prefixes", "host")


def summary(records: DataFrame) -> DataFrame:
    """One row of counts over manifest records (status, url, html_bytes, licence)."""
    n = lambda c: F.count_if(c)
    unclear = F.col("licence").isNull() | F.lower("licence").isin("", "unknown", "unclear")
    return records.agg(
        F.count(F.lit(1)).alias("attempted"), n(F.col("status") == "ok").alias("ok"), n(F.col("status") == "failed").alias("failed"), n(F.col("status") == "skipped").alias("skipped"),
        (F.count(F.lit(1)) - F.countDistinct("url")).alias("duplicate_urls"), n((F.col("status") == "ok") & (F.col("html_bytes") == 0)).alias("empty"), n(unclear).alias("unclear_licence"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) between two tables of path and digest; no rows if they are equal."""
    both = before.withColumnRenamed("digest", "old").join(after.withColumnRenamed("digest", "new"), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


#: Fields that metadata and provenance of a raw record must agree on.
AGREED = ("source_id", "url", "licence", "timestamp")


def raw_violations(raw: DataFrame) -> DataFrame:
    """source_id, violation for every broken rule of joined raw records.

    raw has source_id, html, status, metadata_hash, provenance_hash, and metadata_ and provenance_ columns of each
    field in AGREED; a null equals nothing.
    """
    actual = F.sha2("html", 256)
    rules = F.array(
        F.when(F.coalesce("status", F.lit("")) != "ok", "status is not ok"),
        F.when(~F.coalesce(actual == F.col("metadata_hash"), F.lit(False)), "metadata hash differs"),
        F.when(~F.coalesce(actual == F.col("provenance_hash"), F.lit(False)), "provenance hash differs"),
        *[F.when(~F.coalesce(F.col(f"metadata_{f}") == F.col(f"provenance_{f}"), F.lit(False)), f"{f} differs") for f in AGREED],
    )
    return raw.select("source_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("violation"))


def with_source_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with source_name, by default the id."""
    return rows.join(names.select("source_id", "name"), "source_id", "left").withColumn("source_name", F.coalesce("name", "source_id")).drop("name")


def raw_records(spark: SparkSession, root: str) -> DataFrame:
    """Three files a source (html/*.html, markdown/*.md, metadata/*.json) joined by stem."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    files = lambda kind, ext: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").load(f"{root}/{kind}").select(stem(F.col("path")).alias("source_id"), F.col("content"))
    html = files("html", "html").withColumnRenamed("content", "html")
    markdown = files("markdown", "md").select("source_id", F.decode("content", "utf-8").alias("markdown"))
    metadata = files("metadata", "json").select("source_id", F.decode("content", "utf-8").alias("metadata"))
    return html.join(markdown, "source_id", "full").join(metadata, "source_id", "full")


def count_violations(raw: DataFrame, expected: int) -> DataFrame:
    """source_id (null), violation where raw_records() hold another number of pages or texts than expected."""
    n = raw.agg(F.count("markdown").alias("texts"), F.count("html").alias("pages"))
    said = F.format_string("expected %d texts and pages, found %d and %d", F.lit(expected), "texts", "pages")
    return n.filter((F.col("texts") != expected) | (F.col("pages") != expected)).select(F.lit(None).cast("string").alias("source_id"), said.alias("violation"))


def save_raw(records: DataFrame, path: str) -> None:
    """Raw records (source_id, html as bytes, markdown, metadata) as one table; a later record of an id is another row."""
    records.select("source_id", F.col("html").cast("binary").alias("html"), "markdown", "metadata").write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str, order: str) -> None:
    """JSON lines with sorted keys, ordered by a key."""
    df.orderBy(order).select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON lines; a malformed line fails the read, and so does a file without rows."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"{path} is empty")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
