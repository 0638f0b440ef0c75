"""Counts over an issue and over a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators.dedup import ORDER, url_key


def category_counts(articles: DataFrame, *keys: str) -> DataFrame:
    return articles.groupBy(*keys, "category").agg(F.count("*").alias("articles"))


def subcategory_groups(articles: DataFrame, *keys: str) -> DataFrame:
    """Articles per subcategory with the place it was first seen; blank ones form ``Other``."""
    blank = F.coalesce(F.col("subcategory"), F.lit("")) == ""
    return (
        articles.withColumns({"is_other": blank, "subcategory": F.when(blank, "Other").otherwise(F.col("subcategory"))})
        .groupBy(*keys, "category", "subcategory", "is_other")
        .agg(F.count("*").alias("articles"), F.min(F.struct(*ORDER)).alias("_first"))
        .select(*keys, "category", "subcategory", "is_other", "articles",
                F.col("_first.feed_ord").alias("first_feed"), F.col("_first.entry_ord").alias("first_entry"))
    )


def paywalled_count(articles: DataFrame, *keys: str) -> DataFrame:
    """Paywalled articles and the note a reading list shows (null when there is none)."""
    out = articles.groupBy(*keys).agg(F.count_if(F.coalesce("is_paywalled", F.lit(False))).alias("paywalled"))
    note = F.concat(
        F.lit("*Note: "), F.col("paywalled").cast("string"), F.lit(" article"),
        F.when(F.col("paywalled") > 1, "s").otherwise(""), F.lit(" may be behind a paywall.*"),
    )
    return out.withColumn("note", F.when(F.col("paywalled") > 0, note))


def run_summary(articles: DataFrame) -> DataFrame:
    """Entries, unique, duplicate, processed and failed counts per feed.

    Whether an entry is the first of its URL comes from a partial minimum, joined on the unique order.
    """
    firsts = (
        articles.select(url_key().alias("_url_key"), *ORDER)
        .groupBy("_url_key").agg(F.min(F.struct(*ORDER)).alias("_first"))
        .groupBy("_first.feed_ord").agg(F.count("*").alias("unique_entries"))
    )
    totals = articles.groupBy("feed_ord").agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    out = totals.join(firsts, "feed_ord", "left").withColumn(
        "unique_entries", F.coalesce("unique_entries", F.lit(0).cast("bigint"))
    )
    return out.withColumn("duplicates", F.col("entries") - F.col("unique_entries"))


def weekly_counts(articles: DataFrame, ts: str, category: str = "category", weeks: str = "7 days") -> DataFrame:
    """Articles per tumbling week and category; works on a batch and, with a watermark, on a stream."""
    return (
        articles.groupBy(F.window(ts, weeks).alias("_week"), F.col(category).alias("category"))
        .agg(F.count("*").alias("articles"))
        .select(F.col("_week.start").alias("week_start"), "category", "articles")
    )
