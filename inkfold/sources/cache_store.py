"""The cache as a store of hash buckets: an upsert writes the buckets it touches, and a reader sees one version.

Rows lie in folders by bucket and write. A version is a small table, the manifest, that names for every bucket the write
that holds it, its number of rows and its oldest time; it is the last thing an upsert writes, and readers take the newest
manifest that is whole. So what a write that failed has left behind belongs to no version, and a reader that began before
an upsert keeps reading what its version names. One writer at a time: a second one finds its version taken and fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.schemas import CACHE, CACHE_COLUMNS
from inkfold.sources.cache import cache_expire, cache_upsert

BUCKETS = 256
MANIFEST = "bucket int, write string, n bigint, oldest timestamp"


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions whose manifest is whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The manifest of a version, of the newest by default: at most one row per bucket."""
    versions = _versions(spark, folder)
    if not versions:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/version={versions[-1] if version is None else version}")


def _rows(spark: SparkSession, folder: str, entries: list) -> DataFrame:
    """The rows of some manifest entries, with their ``bucket``."""
    if not entries:
        return spark.createDataFrame([], f"{CACHE}, bucket int")
    paths = [f"{folder}/data/bucket={e['bucket']}/write={e['write']}" for e in entries]
    return spark.read.schema(f"{CACHE}, bucket int").option("basePath", f"{folder}/data").parquet(*paths)


def read_cache_store(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of one version; a store that nothing was written to is empty."""
    return _rows(spark, folder, manifest(spark, folder, version).filter("n > 0").collect()).select(*CACHE_COLUMNS)


def _replace(spark: SparkSession, folder: str, rows: DataFrame, touched: list[int], entries: list) -> int:
    """Write ``rows`` as the new content of the touched buckets, then the manifest of the next version."""
    write = uuid.uuid4().hex
    (rows.withColumn("write", F.lit(write)).repartition("bucket").write.mode("append").partitionBy("bucket", "write")
     .parquet(f"{folder}/data"))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data/bucket=*/write={write}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    new = [{"bucket": int(s.getPath().getParent().getName().split("=")[1]), "write": write} for s in there]
    counted = _rows(spark, folder, new).groupBy("bucket").agg(F.count("*").alias("n"), F.min("cached_at").alias("oldest"))
    kept = [(e["bucket"], e["write"], e["n"], e["oldest"]) for e in entries if e["bucket"] not in set(touched)]
    old = spark.createDataFrame(kept, MANIFEST)
    version = max(_versions(spark, folder), default=0) + 1
    (old.unionByName(counted.select("bucket", F.lit(write).alias("write"), "n", "oldest")).coalesce(1)
     .write.mode("errorifexists").parquet(f"{folder}/manifest/version={version}"))
    return version


def upsert_cache_store(spark: SparkSession, folder: str, rows: DataFrame, buckets: int = BUCKETS) -> int:
    """Put rows into the store, new ones winning over old ones of their URL; returns the version that holds them.

    Only buckets with new rows are read and written. ``buckets`` must be the same for all upserts of a store.
    """
    keyed = rows.select(*CACHE_COLUMNS).withColumn("bucket", bucket_of(F.col("url"), buckets))
    touched = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    entries = manifest(spark, folder).collect()
    old = _rows(spark, folder, [e for e in entries if e["bucket"] in set(touched) and e["n"]])
    merged = cache_upsert(old, keyed).withColumn("bucket", bucket_of(F.col("url"), buckets))
    return _replace(spark, folder, merged, touched, entries)


def expire_cache_store(spark: SparkSession, folder: str, as_of: str, days: int = 7) -> int | None:
    """Drop rows past the cache life; returns the new version, None where nothing was that old.

    The manifest tells which buckets hold old rows; no other bucket is read or written.
    """
    current = manifest(spark, folder)
    old = F.col("oldest") <= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    stale = current.filter((F.col("n") > 0) & old).collect()
    if not stale:
        return None
    kept = cache_expire(_rows(spark, folder, stale), as_of, days)
    return _replace(spark, folder, kept, [e["bucket"] for e in stale], current.collect())
