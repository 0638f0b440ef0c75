"""The cache table: one row per URL, kept as a snapshot that every upsert rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.schemas import CACHE, CACHE_COLUMNS


def cache_rows(processed: DataFrame, as_of: str | Column, content: str = "content", features: str = "features") -> DataFrame:
    """Processed pages in cache form: features as JSON text, stamped with the run time."""
    stamp = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return processed.filter(F.coalesce(F.col("url"), F.lit("")) != "").select(
        "url", F.col(content).alias("content"), F.to_json(features).alias("features"), stamp.alias("cached_at")
    )


def cache_upsert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The next snapshot: the newest row of every URL, new rows winning over old ones.

    ``max_by`` on a partial aggregate keeps one row per URL and task before the shuffle.
    """
    both = cache.select(*CACHE_COLUMNS, F.lit(0).alias("_gen")).unionByName(
        rows.select(*CACHE_COLUMNS, F.lit(1).alias("_gen"))
    )
    rank = F.struct("_gen", "cached_at", "content", "features")
    return both.groupBy("url").agg(F.max(rank).alias("_top")).select(
        "url", "_top.content", "_top.features", "_top.cached_at"
    )


def cache_expire(cache: DataFrame, as_of: str | Column, days: int = 7) -> DataFrame:
    """The snapshot without rows past the cache life."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return cache.filter(F.col("cached_at") > now - F.expr(f"INTERVAL {int(days)} DAYS"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(path)


def write_cache(cache: DataFrame, path: str) -> None:
    """Write a snapshot to a new folder; a snapshot is never written over the one it was read from."""
    cache.write.mode("errorifexists").parquet(path)
