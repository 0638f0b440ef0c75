"""Weekly counts and source health as batch queries, and the same results from streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.operators.health import source_health
from inkfold.operators.summary import weekly_counts
from inkfold.plans.catalog import query
from inkfold.session import work_dir
from inkfold.sources.tables import events_as_fetch_log, table
from inkfold.streaming.health import latest_health, run_source_health
from inkfold.streaming.streams import last_batch, run_dedupe, run_weekly_totals, stream_table

_WEEKS = """
    SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS week_start, event_type AS category, count(*) AS articles
    FROM events GROUP BY 1, 2"""

_HEALTH = """
    WITH RECURSIVE log AS (
      SELECT user_id::VARCHAR AS domain, event_type <> 'error' AS ok,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
             count(*) OVER (PARTITION BY user_id) AS n FROM events),
    fold AS (
      SELECT domain, 0::BIGINT AS i, 0::BIGINT AS failures, 1.0::DOUBLE AS backoff, max(n) AS n FROM log GROUP BY domain
      UNION ALL
      SELECT f.domain, l.i, CASE WHEN l.ok THEN 0 ELSE f.failures + 1 END,
             CASE WHEN l.ok THEN CASE WHEN f.backoff > 1 THEN greatest(1.0, f.backoff * 0.8::DOUBLE) ELSE f.backoff END
                  WHEN f.failures + 1 >= 3 THEN least(60.0, f.backoff * 2.0::DOUBLE) ELSE f.backoff END, f.n
      FROM fold f JOIN log l ON l.domain = f.domain AND l.i = f.i + 1)
    SELECT domain, n AS events, failures, round(backoff, 6) AS backoff FROM fold WHERE i = n"""


def _without_zone(df, name):
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))


def _utc_events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("weekly_counts", _WEEKS)
def weekly_counts_query(spark, sf):
    return _without_zone(weekly_counts(_utc_events(spark, sf), "ts", "event_type"), "week_start")


@query("source_health", _HEALTH)
def source_health_query(spark, sf):
    h = source_health(events_as_fetch_log(table(spark, sf, "events")))
    return h.withColumn("backoff", F.round("backoff", 6))


@query("stream_weekly_totals", _WEEKS)
def stream_weekly_totals(spark, sf):
    out = work_dir(spark, "weekly")
    events = stream_table(spark, table(spark, sf, "events"), sf, "events.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    run_weekly_totals(events, f"{out}/data", f"{out}/log", "ts", "event_type").awaitTermination()
    return _without_zone(last_batch(spark, f"{out}/data"), "week_start")


#: Parts that the log is streamed in, and one event of how many is handed in one part late.
LOG_PARTS, ONE_LATE_OF = 3, 7


@query("stream_source_health", _HEALTH)
def stream_source_health(spark, sf):
    """The log in parts by time, the stream started anew for each; one event of seven comes with the next part."""
    out = work_dir(spark, "health")
    log = events_as_fetch_log(table(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = log.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    span = ((high or 0) - (low or 0)) // LOG_PARTS + 1
    late = (F.col("event_id") % ONE_LATE_OF == 0).cast("int")
    part = F.least(F.expr(f"(unix_seconds(ts) - {low or 0}) div {span}") + late, F.lit(LOG_PARTS - 1))
    log = log.withColumn("part", part)
    for i in range(LOG_PARTS):
        log.filter(F.col("part") == i).drop("part").write.mode("append").parquet(f"{out}/log")
        stream = spark.readStream.schema(log.drop("part").schema).parquet(f"{out}/log")
        run_source_health(stream, f"{out}/data", f"{out}/checkpoint", f"{2 * span} seconds").awaitTermination()
    return latest_health(spark, f"{out}/data").withColumn("backoff", F.round("backoff", 6))


@query("stream_dedupe", """
    SELECT md5(text) AS url, min(doc_id) AS entry_ord FROM documents GROUP BY 1""")
def stream_dedupe(spark, sf):
    """Documents by content address as a stream; the first of every address is kept."""
    out = work_dir(spark, "dedupe")
    docs = stream_table(spark, table(spark, sf, "documents"), sf, "documents.parquet").select(
        F.md5("text").alias("url"), F.lit(1).cast("bigint").alias("feed_ord"), F.col("doc_id").alias("entry_ord"),
        F.lit("2024-01-01").cast("timestamp").alias("published_ts"),
    )
    run_dedupe(docs, f"{out}/data", f"{out}/log").awaitTermination()
    return spark.read.parquet(f"{out}/data").select("url", "entry_ord")
