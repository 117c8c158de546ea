"""Queries over scalar text functions and the collection's bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import collect as C
from . import sql as S


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalise_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalise_key("text"), 256).alias("key_hash"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.stable_id("doc", "source", "text").alias("document_id"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("word_count"))
    return rows.withColumn("approximate_token_count", T.approximate_tokens(F.col("word_count")))


def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.search_tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_hash"))


def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.safe_filename("url").alias("file_name"))


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.html_title("html").alias("title"))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "pages").select("page_id", T.html_to_text("html").alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_hash"))


def bindings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region as a SPARQL answer, and back to a table."""
    rows = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    binding = lambda n: F.struct(F.struct(n["n_nationkey"].cast("string").alias("value")).alias("key"), F.struct(n["n_name"].alias("value")).alias("name"))
    payload = F.to_json(F.struct(F.struct(F.transform("ns", binding).alias("bindings")).alias("results")))
    return rows.select(F.col("n_regionkey").cast("long").alias("region"), T.bindings_table(payload).alias("markdown"))


def category_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("ns"))
    payload = F.to_json(F.struct(F.struct(F.transform("ns", lambda n: F.struct(n.alias("title"))).alias("categorymembers")).alias("query")))
    return rows.select(F.col("n_regionkey").cast("long").alias("region"), T.category_list(payload).alias("markdown"))


def provenance_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    header = T.provenance_header(
        source_id="source", source_url=F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")), page_title=F.concat(F.lit("Document: "), F.col("doc_id").cast("string")), licence=F.lit("CC-BY-4.0"),
        licence_url=F.lit("https://example.org/licence"), retrieved=F.lit("2024-01-01T00:00:00Z"), content_hash_sha256=F.sha2("text", 256), http_status=F.lit(200),
    )
    rows = d.select("doc_id", F.col("text"), T.parse_provenance(F.concat(header, F.lit("\n\n"), F.col("text"))).alias("p"))
    f = lambda k: F.element_at("p.fields", k)
    return rows.select("doc_id", f("source_id").alias("source_id"), f("source_url").alias("source_url"), f("page_title").alias("page_title"), (f("content_hash_sha256") == F.sha2("p.body", 256)).alias("intact"), F.col("p.valid").alias("valid"))


def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    title = F.when(k == 0, F.concat("text", F.lit(" - Wikipedia"))).when(k == 1, "").when(k == 2, F.concat("text", F.lit(" |  PROV")))
    return d.select("doc_id", T.document_title(title, "source").alias("title"))


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.clean_name("text").alias("name"), T.duplicate_name_key("text").alias("name_key"))


def stripped_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the whole text, each with marks around it."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")).alias("n", "line"))
    line = F.concat(F.lit("**Note** ![i](u) [link](http://x) [12] <b>*"), "line", F.lit("*</b> `code`"))
    return lines.select("doc_id", "n", T.strip_markdown(line).alias("line"))


def confidence_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", T.confidence_badge("value", 10.0).alias("badge"))


def evaluation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("source"))
    return _table(spark, sf_dir, "documents").select("doc_id", T.evaluation_id(parent, F.col("doc_id").cast("string")).alias("evaluation_id"))


def url_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_urls(_table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url")), "page_id")


def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, False).when(F.col("page_id") % 3 == 1, True).alias("enabled"))
    return C.enabled(rows).select("page_id", "url")


def collect_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 11 == 0).alias("collected"), (F.col("page_id") % 7 != 0).alias("allowed"), F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("http_status"), F.when(F.col("page_id") % 13 == 0, F.lit("short")).otherwise(F.col("html")).alias("body"))
    return rows.select("page_id", C.status("collected", "allowed", "http_status", "body").alias("status"), C.reason("collected", "allowed", "http_status", "body").alias("reason"))


def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collect_status(spark, sf_dir).join(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
    return C.summary(rows.select("status", "url", F.octet_length("html").alias("html_bytes"), F.lit(None).cast("string").alias("licence")))


def incremental_new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return C.new_sources(pages, pages.filter(F.col("page_id") % 4 == 0), "page_id")


def raw_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    before = pages.select(F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("digest"))
    after = pages.filter(F.col("page_id") % 10 != 3).select(F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 10 == 4, F.sha2(F.concat("html", F.lit("x")), 256)).otherwise(F.sha2("html", 256)).alias("digest"))
    return C.snapshot_diff(before, after)


def raw_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    bad = lambda m, wrong, right: F.when(F.col("page_id") % m == 0, F.lit(wrong)).otherwise(right)
    digest, id_ = F.sha2("html", 256), F.col("page_id").cast("string")
    raw = p.select(
        id_.alias("source_id"), F.encode("html", "utf-8").alias("html"), bad(8, "failed", F.lit("ok")).alias("status"),
        bad(13, "1", digest).alias("metadata_hash"), bad(9, "0", digest).alias("provenance_hash"),
        id_.alias("metadata_source_id"), bad(11, "x", id_).alias("provenance_source_id"),
        F.col("url").alias("metadata_url"), bad(7, "x", F.col("url")).alias("provenance_url"),
        bad(17, None, F.lit("CC-BY-4.0")).alias("metadata_licence"), F.lit("CC-BY-4.0").alias("provenance_licence"),
        F.lit("2024-01-01").alias("metadata_timestamp"), bad(19, "2024-01-02", F.lit("2024-01-01")).alias("provenance_timestamp"),
    )
    return C.raw_violations(raw)


def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"))
    names = d.select("source_id").distinct().filter(F.col("source_id").isin("src1", "src2", "src3")).withColumn("name", F.concat(F.lit("Source "), F.substring("source_id", 4, 9)))
    return C.with_source_names(d, names)


def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.agg(F.count(F.lit(1)).alias("documents"), (F.count(F.lit(1)) - F.countDistinct(F.sha2("text", 256))).alias("exact_duplicates"), (F.count(F.lit(1)) - F.countDistinct(F.sha2(T.normalise_key("text"), 256))).alias("normalised_duplicates"))


def robots_and_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch schedule: requests to one host are two seconds apart at least."""
    p = _table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))
    return C.schedule(p, "host", "page_id")


PAGES_STATUS = """SELECT page_id, url, html, CASE WHEN page_id % 11 = 0 THEN 'skipped' WHEN page_id % 7 = 0 THEN 'failed' WHEN page_id % 5 = 0 THEN 'failed' WHEN strlen(CASE WHEN page_id % 13 = 0 THEN 'short' ELSE html END) < 100 THEN 'failed' ELSE 'ok' END AS status,
 CASE WHEN page_id % 11 = 0 THEN 'already collected' WHEN page_id % 7 = 0 THEN 'robots disallowed' WHEN page_id % 5 = 0 THEN 'HTTP 404' WHEN strlen(CASE WHEN page_id % 13 = 0 THEN 'short' ELSE html END) < 100 THEN 'body too small' END AS reason FROM pages"""

QUERIES = {f.__name__: f for f in (
    normalise_key, stable_ids, word_counts, search_tokens, safe_filename, html_title, html_to_text, bindings_table, category_list, provenance_roundtrip, document_titles, clean_names,
    stripped_markdown, confidence_badges, evaluation_ids, url_duplicates, enabled_sources, collect_status, collection_summary, incremental_new_pages, raw_snapshot_diff, raw_violations, source_names, content_duplicates, robots_and_waits,
)}

ORACLE_SQL = {
    "normalise_key": f"SELECT doc_id, sha256({S.normalise_key('text')}) AS key_hash FROM documents",
    "stable_ids": f"SELECT doc_id, {S.stable_id('doc', 'source', 'text')} AS document_id FROM documents",
    "word_counts": f"SELECT doc_id, {S.word_count('text')} AS word_count, ceil({S.word_count('text')} * 1.33::DOUBLE)::BIGINT AS approximate_token_count FROM documents",
    "search_tokens": f"SELECT doc_id, len({S.search_tokens('text')})::BIGINT AS n_tokens, sha256(array_to_string({S.search_tokens('text')}, ' ')) AS tokens_hash FROM documents",
    "safe_filename": "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS file_name FROM pages",
    "html_title": "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), ''), '(no title)') AS title FROM pages",
    "html_to_text": f"SELECT page_id, length({S.html_to_text('html')})::BIGINT AS n_chars, sha256({S.html_to_text('html')}) AS text_hash FROM pages",
    "bindings_table": "SELECT n_regionkey::BIGINT AS region, 'key | name' || chr(10) || '--- | ---' || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey, n_name) AS markdown FROM nation GROUP BY 1",
    "category_list": "SELECT n_regionkey::BIGINT AS region, '# Wikipedia Category Members' || chr(10) || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS markdown FROM nation GROUP BY 1",
    "provenance_roundtrip": "SELECT doc_id, source AS source_id, 'https://example.org/' || doc_id AS source_url, 'Document: ' || doc_id AS page_title, sha256(text) = sha256(ltrim(text, chr(10) || chr(9) || chr(13) || ' ')) AS intact, true AS valid FROM documents",
    "document_titles": "SELECT doc_id, regexp_replace(CASE WHEN doc_id % 4 IN (0, 2) THEN text ELSE source END, '^\\s+|\\s+$', '', 'g') AS title FROM documents",
    "clean_names": f"SELECT doc_id, trim(regexp_replace(regexp_replace(trim(text), '^(?:The|A|An)\\s+', ''), '\\s+', ' ', 'g'), ' ,.;:()[]') AS name, CASE WHEN length(k) >= 5 THEN k END AS name_key FROM (SELECT *, regexp_replace({S.casefold('text')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k FROM documents)",
    "confidence_badges": "SELECT event_id, CASE WHEN value >= 20 THEN 'High' WHEN value >= 10 THEN 'Moderate' ELSE 'Below threshold' END AS badge FROM events",
    "evaluation_ids": "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN source ELSE doc_id::VARCHAR END AS evaluation_id FROM documents",
    "url_duplicates": "SELECT page_id, url, first_value(page_id) OVER (PARTITION BY url ORDER BY page_id) AS first_id, row_number() OVER (PARTITION BY url ORDER BY page_id) > 1 AS is_duplicate FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)",
    "enabled_sources": "SELECT page_id, url FROM pages WHERE page_id % 3 <> 0",
    "collect_status": f"SELECT page_id, status, reason FROM ({PAGES_STATUS})",
    "collection_summary": f"SELECT count(*) AS attempted, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) - count(DISTINCT url) AS duplicate_urls, count(*) FILTER (status = 'ok' AND strlen(html) = 0) AS empty, count(*) AS unclear_licence FROM ({PAGES_STATUS})",
    "incremental_new_pages": "SELECT page_id, url FROM pages WHERE page_id % 4 <> 0",
    "raw_snapshot_diff": "SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 10 = 3 THEN 'removed' ELSE 'changed' END AS change FROM pages WHERE page_id % 10 IN (3, 4)",
    "raw_violations": " UNION ALL ".join(f"SELECT page_id::VARCHAR AS source_id, '{v}' AS violation FROM pages WHERE page_id % {m} = 0" for m, v in ((8, "status is not ok"), (13, "metadata hash differs"), (9, "provenance hash differs"), (11, "source_id differs"), (7, "url differs"), (17, "licence differs"), (19, "timestamp differs"))),
    "source_names": "SELECT doc_id, source AS source_id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'Source ' || substr(source, 4) ELSE source END AS source_name FROM documents",
    "content_duplicates": f"SELECT count(*) AS documents, count(*) - count(DISTINCT text) AS exact_duplicates, count(*) - count(DISTINCT {S.normalise_key('text')}) AS normalised_duplicates FROM documents",
    "robots_and_waits": "SELECT page_id, split_part(split_part(split_part(split_part(url, '/', 3), ':', 1), '?', 1), '#', 1) AS host, ((row_number() OVER (PARTITION BY split_part(split_part(split_part(split_part(url, '/', 3), ':', 1), '?', 1), '#', 1) ORDER BY page_id) - 1) * 2.0)::DOUBLE AS start_after_s FROM pages",
}
