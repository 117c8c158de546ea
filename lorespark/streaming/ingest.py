"""Incremental ingestion of pages: each run takes what is new since the last and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = "page_id long, url string, html string"


def pages_stream(spark: SparkSession, source: str) -> DataFrame:
    """Pages with content hash, title and text; a page whose content came before is dropped."""
    rows = spark.readStream.schema(PAGE).parquet(source)
    rows = rows.withColumns({"content_hash": F.sha2("html", 256), "title": T.html_title("html"), "text": T.html_to_text("html")})
    return rows.dropDuplicates(["content_hash"])


def run_available(spark: SparkSession, source: str, out: str, checkpoint: str) -> None:
    """Append all new pages to the Parquet table out; the checkpoint remembers files and hashes."""
    query = pages_stream(spark, source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
