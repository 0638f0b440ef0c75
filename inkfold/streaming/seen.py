"""An index of the URLs that were sent, for streams that must not send one twice.

URLs are dealt to cells by hash. Every batch appends its URLs, in folders by bucket (a range of cells), and one Bloom
filter per cell it touches, a bitmap of 32,768 bits. A new batch is held against the filters first: what no filter knows
is new and is joined with nothing. Only the buckets of the rest are read, and decide exactly. Batches whose URLs no longer
block anything take no part. Bitmaps are made, united and tested in the JVM.

A batch owns its folders, and sees only batches before it, so one that is run again after a failure gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells and the buckets they lie in. A cell's filter is good for some 3,000 URLs: 4,096 cells for some 12 million.
CELLS, BUCKETS = 4096, 64
#: Bits of a filter that a URL sets, and bits of a filter.
PROBES, BITS = 4, 32_768
URLS = "_url_key string, _sent timestamp, batch bigint, bucket int"
FILTERS = "cell int, bits binary, undated boolean, newest timestamp, batch bigint"


def cell_of(key: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(cells)).cast("int")


def probes_of(key: Column) -> Column:
    """The bits of a URL, in 0 to BITS - 1."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITS)).cast("bigint") for i in range(1, PROBES + 1)])


def has_bits(bits: Column, probes: Column) -> Column:
    """Whether a bitmap has all of some bits."""
    def one(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.expr("1") == F.floor(byte / F.pow(F.lit(2), p % 8)) % 2

    return F.forall(probes, one)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that batches append to; empty before the first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def append_seen(sent: DataFrame, index: str, batch_id: int, key: str, ts: str, cells: int = CELLS, buckets: int = BUCKETS) -> None:
    """Write the URLs of a batch, and their filters. Rows without a URL of their own need no index and are left out by the
    caller."""
    rows = sent.select(F.col(key).alias("_url_key"), F.col(ts).alias("_sent"), cell_of(F.col(key), cells).alias("cell"))
    (rows.select("_url_key", "_sent", F.expr(f"cell div {cells // buckets}").cast("int").alias("bucket"))
     .repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{index}/urls/batch={batch_id}"))
    filters = rows.select("cell", "_sent", F.explode(probes_of(F.col("_url_key"))).alias("bit")).groupBy("cell").agg(
        F.bitmap_construct_agg("bit").alias("bits"), F.coalesce(F.bool_or(F.col("_sent").isNull()), F.lit(False)).alias("undated"),
        F.max("_sent").alias("newest"))
    filters.write.mode("overwrite").parquet(f"{index}/filters/batch={batch_id}")


def maybe_seen(rows: DataFrame, index: str, batch_id: int, key: str, oldest: Column | None, cells: int = CELLS) -> DataFrame:
    """The keys that a filter of an earlier batch knows, with their cells: all that were sent, and few others.

    ``oldest`` is the time from which a sent URL can still block; None if any time can.
    """
    filters = _stored(rows.sparkSession, f"{index}/filters", FILTERS).filter(F.col("batch") < batch_id)
    if oldest is not None:
        filters = filters.filter(F.col("undated") | (F.col("newest") > oldest))
    united = filters.groupBy("cell").agg(F.bitmap_or_agg("bits").alias("bits"))
    keys = rows.select(key, cell_of(F.col(key), cells).alias("cell"))
    return keys.join(united, "cell").filter(has_bits(F.col("bits"), probes_of(F.col(key)))).select(key, "cell")


def sent_before(rows: DataFrame, index: str, batch_id: int, key: str, oldest: Column | None, cells: int = CELLS,
                buckets: int = BUCKETS) -> DataFrame:
    """The keys of ``rows`` that earlier batches sent: ``key`` and ``_sent``, the last time, null where one had none.

    Only the buckets that a filter points to are read.
    """
    spark = rows.sparkSession
    known = maybe_seen(rows, index, batch_id, key, oldest, cells)
    wanted = known.select(F.expr(f"cell div {cells // buckets}").cast("int").alias("b")).distinct().collect()  # at most ``buckets``
    history = _stored(spark, f"{index}/urls", URLS).filter(
        (F.col("batch") < batch_id) & F.col("bucket").isin([r["b"] for r in wanted]))
    if oldest is not None:
        history = history.filter(F.col("_sent").isNull() | (F.col("_sent") > oldest))
    last = history.groupBy("_url_key").agg(F.max(F.struct(F.col("_sent").isNull().alias("always"), "_sent")).alias("s"))
    return last.join(known.select(F.col(key).alias("_url_key")), "_url_key", "left_semi").select(
        F.col("_url_key").alias(key), F.when(~F.col("s.always"), F.col("s._sent")).alias("_sent"))
