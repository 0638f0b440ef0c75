"""Adapters from stored tables to the article, page and fetch-log shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions.text import domain, parse_published
from inkfold.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages ``(page_id, url, html)`` with their domain."""
    return spark.read.parquet(path).withColumn("domain", domain("url"))


def documents_as_articles(documents: DataFrame, *keep: str) -> DataFrame:
    """Article view of a document table: title is the first line, one feed, ordered by id.

    ``keep`` names further columns to carry along.
    """
    docs = spread(documents)
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string"))
    return docs.select(
        F.lit(1).cast("bigint").alias("feed_ord"),
        F.col("doc_id").cast("bigint").alias("entry_ord"),
        F.substring_index("text", "\n", 1).alias("title"),
        url.alias("url"),
        F.lit(None).cast("string").alias("image_url"),
        F.lit(None).cast("string").alias("author"),
        F.col("source"),
        F.lit("").alias("summary"),
        url.alias("read_more_url"),
        F.lit(None).cast("string").alias("published"),
        F.col("text").alias("full_text"),
        F.col("text").alias("content"),
        *keep,
    )


def pages_as_articles(pages: DataFrame, feed_ord: int = 2) -> DataFrame:
    """Article view of a page table: no text yet, only an address."""
    return spread(pages).select(
        F.lit(feed_ord).cast("bigint").alias("feed_ord"),
        F.col("page_id").cast("bigint").alias("entry_ord"),
        F.lit("").alias("title"),
        F.col("url"),
        F.lit(None).cast("string").alias("image_url"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("source"),
        F.lit("").alias("summary"),
        F.col("url").alias("read_more_url"),
        F.lit(None).cast("string").alias("published"),
        F.lit(None).cast("string").alias("full_text"),
        F.lit(None).cast("string").alias("content"),
    )


def events_as_fetch_log(events: DataFrame) -> DataFrame:
    """Fetch-log view of an event table: the user is the domain, every event but an error is a success."""
    return events.select(
        "event_id", "ts", F.col("user_id").cast("string").alias("domain"),
        (F.col("event_type") != "error").alias("ok"),
    )


def with_typed_published(articles: DataFrame) -> DataFrame:
    return articles.withColumn("published_ts", parse_published("published"))
