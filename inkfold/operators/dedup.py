"""First-wins de-duplication, per-feed limit, duplicate report, not-seen-before filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.text import blank_if_null

ORDER = ("feed_ord", "entry_ord")


def url_key(url: str = "url", empty_is_one: bool = False) -> Column:
    """Key under which articles count as the same.

    A missing URL is nobody's duplicate: such rows get a key of their own, which also spreads them over
    all tasks. ``empty_is_one`` makes them one article instead.
    """
    if empty_is_one:
        return blank_if_null(url)
    own = F.concat_ws(":", F.lit("\x00"), *[F.col(c).cast("string") for c in ORDER])
    return F.when(blank_if_null(url) == "", own).otherwise(F.col(url))


def union_feeds(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def limit_per_feed(articles: DataFrame, n: int = 0) -> DataFrame:
    """The first ``n`` entries of every feed; 0 keeps all. ``entry_ord`` counts from 1."""
    return articles.filter(F.col("entry_ord") <= n) if n > 0 else articles


def dedupe_by_url(articles: DataFrame, url: str = "url", empty_is_one: bool = False) -> DataFrame:
    """The first article of every URL in feed order, then entry order.

    ``row_number() = 1`` is planned with a rank limit before the shuffle, so each task sends at most one
    row per URL however often that URL is repeated.
    """
    first = Window.partitionBy("_url_key").orderBy(*ORDER)
    return (
        articles.withColumn("_url_key", url_key(url, empty_is_one))
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .drop("_url_key", "_rank")
    )


def duplicate_report(articles: DataFrame, url: str = "url", empty_is_one: bool = False) -> DataFrame:
    """The rows ``dedupe_by_url`` drops.

    First rows come from a partial minimum per URL; the anti-join is on the unique order key, so a
    URL with very many copies stays spread out.
    """
    firsts = (
        articles.select(url_key(url, empty_is_one).alias("_url_key"), *ORDER)
        .groupBy("_url_key").agg(F.min(F.struct(*ORDER)).alias("_first"))
        .select("_first.*")
    )
    return articles.join(firsts, list(ORDER), "left_anti").select(*articles.columns)


def only_new(articles: DataFrame, history: DataFrame, url: str = "url") -> DataFrame:
    """Articles whose URL is not in the history of sent ones."""
    seen = history.select(F.col(url).alias("_url_key")).distinct()
    return (
        articles.withColumn("_url_key", url_key(url))
        .join(seen, "_url_key", "left_anti")
        .select(*articles.columns)
    )
