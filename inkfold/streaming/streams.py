"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions.text import blank_if_null
from inkfold.operators.dedup import dedupe_by_url, url_key
from inkfold.operators.summary import weekly_counts
from inkfold.sources.feeds import HEAD, MARK, OPENED, entry_fields, feed_file, parsed_entry
from inkfold.streaming.seen import append_seen, sent_before


def stream_entries(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None, glob: str = "*.atom"
) -> DataFrame:
    """New files of a folder (or of the folders a pattern names) as a stream of entries: ``feed_file``, ``raw`` and ``entry``, which is null where
    the entry is malformed. Large files are read in pieces."""
    reader = spark.readStream.option("lineSep", MARK).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # what stands before a feed's first entry does not go on as the mark of an entry would
    opened = reader.text(folder).select(feed_file().alias("feed_file"), F.col("value").alias("raw")).filter(
        F.col("raw").rlike(OPENED) & ~F.col("raw").rlike(HEAD))
    return opened.withColumn("entry", parsed_entry(F.col("raw")))


def stream_articles(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The articles of new feed files; ``feed_file`` tells the feed. Malformed entries are left out."""
    entries = stream_entries(spark, folder, files_per_trigger).filter(F.col("entry").isNotNull())
    return entries.select("feed_file", *[v.alias(k) for k, v in entry_fields("entry.").items()])


def run_articles(
    spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_trigger: int | None = None, glob: str = "*.atom"
):
    """Start a stream of feed files into two tables: ``out/articles`` and, for malformed entries, ``out/corrupt``.

    Every batch owns a folder in each, so a batch that is run again after a failure replaces its own rows only and no
    row comes twice. The corrupt table has the text of the entry, from its mark on, to be mended and handed in again.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        good = F.col("entry").isNotNull()
        articles = batch.filter(good).select("feed_file", *[v.alias(k) for k, v in entry_fields("entry.").items()])
        articles.write.mode("overwrite").parquet(f"{out}/articles/batch={batch_id}")
        corrupt = batch.filter(~good).select("feed_file", F.concat(F.lit(MARK), "raw").alias("raw"))
        corrupt.write.mode("overwrite").parquet(f"{out}/corrupt/batch={batch_id}")

    return (
        stream_entries(spark, folder, files_per_trigger, glob).writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_table(spark: SparkSession, like: DataFrame, folder: str, file: str) -> DataFrame:
    """A stored table, one file or a folder of part files, as a stream with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        return reader.parquet(f"{folder}/{file}")
    return reader.option("pathGlobFilter", file).parquet(folder)


def dedupe_within_watermark(
    articles: DataFrame, ts: str = "published_ts", url: str = "url", life: str = "7 days"
) -> DataFrame:
    """First-arrived article of a URL within the cache life, as one stateful operator.

    ``ts`` must be set; use ingest time where an article has no date. All copies of a URL in a batch
    meet in one task: for feeds with very hot URLs use ``run_dedupe``.
    """
    return articles.withWatermark(ts, life).dropDuplicatesWithinWatermark([url])


def run_dedupe(
    articles: DataFrame, out: str, checkpoint: str, ts: str = "published_ts", url: str = "url",
    life: str = "7 days", index: str | None = None,
):
    """Start a stream that appends articles not seen within the cache life to ``out``.

    Inside a micro-batch the first article in (feed, entry) order wins, by the batch operator with its rank limit before
    the shuffle. These are written once and held against the index of URLs sent before (``index``, by default a folder
    beside ``out``), of which only the buckets that its filters point to are read. A sent URL blocks a later article for
    the cache life; one without a time always does. Every batch owns its folders, so a batch that is run again after a
    failure replaces its own output only.
    """
    index = index or f"{out.rstrip('/')}-seen"

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{index}/staged/batch={batch_id}"
        dedupe_by_url(batch, url).withColumn("_url_key", url_key(url)).write.mode("overwrite").parquet(staged)
        firsts = spark.read.parquet(staged)
        named = firsts.filter(blank_if_null(url) != "")
        low, undated = named.agg(F.min(ts), F.count_if(F.col(ts).isNull())).first()
        oldest = F.lit(low) - F.expr(f"INTERVAL {life}") if low is not None and not undated else None
        before = sent_before(named, index, batch_id, "_url_key", oldest)
        blocked = named.select("_url_key", F.col(ts).alias("_event")).join(before, "_url_key").filter(
            F.col("_event").isNull() | F.col("_sent").isNull()
            | (F.col("_event") < F.col("_sent") + F.expr(f"INTERVAL {life}"))).select("_url_key")
        sent = firsts.join(blocked, "_url_key", "left_anti")
        sent.drop("_url_key").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        done = spark.read.schema(sent.drop("_url_key").schema).parquet(f"{out}/batch={batch_id}")
        append_seen(done.filter(blank_if_null(url) != ""), index, batch_id, url, ts)

    return (
        articles.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_weekly_counts(
    articles: DataFrame, out: str, checkpoint: str, ts: str, category: str = "category", lateness: str = "7 days",
):
    """Start a stream of tumbling weekly counts; a week is written once the watermark has passed it."""
    counts = weekly_counts(articles.withWatermark(ts, lateness), ts, category)
    return (
        counts.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_weekly_totals(articles: DataFrame, out: str, checkpoint: str, ts: str, category: str = "category"):
    """Start a stream that keeps the counts of all weeks so far in ``out/batch=N``; the last batch is current."""
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        weekly_counts(articles, ts, category).writeStream.outputMode("complete").foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def last_batch(spark: SparkSession, out: str) -> DataFrame:
    """The newest ``batch=N`` folder of an output that is rewritten batch by batch."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    newest = max(int(n.split("=", 1)[1]) for n in names if n.startswith("batch="))
    return spark.read.parquet(f"{out}/batch={newest}")
