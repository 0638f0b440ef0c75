"""Streams give what the batch operators give."""

import random
import re

from pyspark.sql import functions as F
from test_feeds import BARE, FULL, HEAD

from inkfold.operators.health import source_health
from inkfold.operators.summary import weekly_counts
from inkfold.streaming.health import latest_health, run_source_health
from inkfold.streaming.seen import append_seen, maybe_seen, sent_before
from inkfold.streaming.streams import dedupe_within_watermark, run_dedupe, run_weekly_counts, stream_articles


def write_parts(spark, rows, schema, folder, stamp="ts"):
    """One file per inner list, in order."""
    import os

    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, schema).withColumn(stamp, F.timestamp_seconds(stamp))
        tmp = f"{folder}-{i}"
        df.coalesce(1).write.parquet(tmp)
        os.makedirs(folder, exist_ok=True)
        file = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
        os.link(f"{tmp}/{file}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (1000 + i * 10, 1000 + i * 10))
    batch = spark.read.parquet(folder)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)


DAY = 86_400


def test_articles_from_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.atom").write_text(HEAD + FULL + BARE + "</feed>")
    (tmp_path / "in" / "b.txt").write_text(HEAD + FULL + "</feed>")
    q = (stream_articles(spark, str(tmp_path / "in")).writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["title"], r["url"]) for r in got) == [("T & one", "https://u@a.com:80/1"), ("two", "")]


ARTICLES = "feed_ord long, entry_ord long, url string, published_ts long"
PARTS = [
    [(2, 1, "a", 60), (1, 1, "a", 65), (1, 2, None, 60), (1, 3, None, 60), (1, 4, "b", 60)],
    [(1, 5, "a", 3 * DAY), (1, 6, "c", 3 * DAY)],
    [(1, 7, "a", 8 * DAY), (1, 8, "c", 8 * DAY)],
]


def test_dedupe_over_batches(spark, tmp_path):
    _, stream = write_parts(spark, PARTS, ARTICLES, str(tmp_path / "in"), "published_ts")
    for _ in range(2):
        run_dedupe(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    # "a" comes again after its seven days, "c" is still known.
    assert sorted(r["entry_ord"] for r in got) == [1, 2, 3, 4, 6, 7]
    assert [r["feed_ord"] for r in got if r["url"] == "a" and r["entry_ord"] == 1] == [1]


def test_index_of_seen_urls(spark, tmp_path):
    """All that was sent is found; a small batch reads few buckets; filters know few other URLs."""
    index = str(tmp_path / "index")
    day = lambda n, low, high, at: spark.range(low, high).select(
        F.concat(F.lit("https://u/"), F.col("id").cast("string")).alias("url"), F.timestamp_seconds(F.lit(at * DAY)).alias("ts"))
    append_seen(day(0, 0, 60_000, 1), index, 0, "url", "ts")
    append_seen(day(1, 60_000, 60_010, 20).withColumn("ts", F.when(F.col("url") != "https://u/60001", F.col("ts"))), index, 1, "url", "ts")
    some = day(2, 59_990, 70_000, 21)
    found = {r["url"]: r["_sent"] for r in sent_before(some, index, 2, "url", None).collect()}
    assert set(found) == {f"https://u/{i}" for i in range(59_990, 60_010)} and found["https://u/60001"] is None
    assert maybe_seen(some, index, 2, "url", None).count() < 60
    few = sent_before(day(2, 5, 7, 21), index, 2, "url", None)
    assert re.search(r"PartitionFilters: \[[^]]*\(?bucket#\d+ (=|IN \()", few._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert few.count() == 2 and maybe_seen(day(2, 5, 7, 21), index, 2, "url", None).count() == 2
    # what is older than the life blocks nothing, and a batch does not see itself or later ones
    late = sent_before(some, index, 2, "url", F.timestamp_seconds(F.lit(14 * DAY)))
    assert late.count() == 10 and sent_before(some, index, 0, "url", None).count() == 0


def test_dedupe_is_exact_over_many_batches(spark, tmp_path):
    rng = random.Random(3)
    parts = [[(1, 100 * b + i, rng.choice([f"u{rng.randrange(25)}", f"u{rng.randrange(25)}", None, ""]),
               (2 * b + rng.randrange(3)) * DAY if rng.random() < 0.9 else None) for i in range(30)] for b in range(4)]
    _, stream = write_parts(spark, parts, ARTICLES, str(tmp_path / "in"), "published_ts")
    run_dedupe(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    sent, want = {}, []
    for part in parts:
        firsts = {}
        for row in sorted(part):
            firsts.setdefault(row[2] or row[1], row)
        keep = [r for r in firsts.values() if not r[2] or not any(
            t is None or r[3] is None or r[3] < t + 7 * DAY for t in sent.get(r[2], []))]
        for r in keep:
            sent.setdefault(r[2], []).append(r[3])
        want += [r[1] for r in keep]
    assert sorted(r["entry_ord"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)


def test_dedupe_operator(spark, tmp_path):
    _, stream = write_parts(spark, PARTS[:2], ARTICLES, str(tmp_path / "in"), "published_ts")
    q = (dedupe_within_watermark(stream.filter("url is not null")).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_weekly_counts_after_the_watermark(spark, tmp_path):
    rows = [[(i * DAY, "AI" if i % 2 else "Other") for i in range(10)], [(i * DAY, "AI") for i in range(10, 40)], [(60 * DAY, "AI")]]
    batch, stream = write_parts(spark, rows, "ts long, category string", str(tmp_path / "in"))
    run_weekly_counts(stream, str(tmp_path / "out"), str(tmp_path / "log"), "ts").awaitTermination()
    got = {(r["week_start"], r["category"]): r["articles"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["week_start"], r["category"]): r["articles"] for r in weekly_counts(batch, "ts").collect()}
    last = max(w for w, _ in want)
    assert got == {k: v for k, v in want.items() if k[0] < last}


def test_source_health_puts_late_events_in_their_place(spark, tmp_path):
    log = [(i, 5000 + i // 2, f"d{i % 3}", i % 5 == 0) for i in range(300)]
    early, late = [e for e in log[:200] if e[0] % 7], [e for e in log[:200] if not e[0] % 7] + log[200:280]
    last = [*log[280:], (900, 6000, "d0", True), (901, 6000, None, True)]
    batch, stream = write_parts(spark, [early, late, last], "event_id long, ts long, domain string, ok boolean", str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run_source_health(stream, out, str(tmp_path / "log"), "200 seconds").awaitTermination()
    rows = lambda df: {r["domain"]: (r["events"], r["failures"], round(r["backoff"], 9)) for r in df.collect()}
    assert rows(latest_health(spark, out)) == rows(source_health(batch))
    # what lies before the watermark has been settled; an event that is later than that is dropped, others count
    more = spark.createDataFrame([(902, 5003, "d1", True), (903, 5990, "d1", False), (904, 6001, "new", False)], batch.schema.simpleString()[7:-1]
                                 .replace("ts:timestamp", "ts:bigint")).withColumn("ts", F.timestamp_seconds("ts"))
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run_source_health(stream, out, str(tmp_path / "log"), "200 seconds").awaitTermination()
    want = rows(source_health(spark.read.parquet(str(tmp_path / "in")).filter("event_id <> 902")))
    assert rows(latest_health(spark, out)) == want and want["new"] == (1, 1, 1.0)


def test_streamed_tables_may_be_folders_of_parts(spark, tmp_path):
    from inkfold.plans import catalog

    catalog.load()
    docs = [(i, None if i == 7 else f"text {i % 5}") for i in range(40)]
    events = [(i, 86_400 * i, "view" if i % 3 else "click") for i in range(40)]
    for parts, at in ((3, tmp_path / "parts"), (1, tmp_path / "file")):
        for name, rows, schema in (("documents", docs, "doc_id long, text string"),
                                   ("events", events, "event_id long, ts long, event_type string")):
            df = spark.createDataFrame(rows, schema)
            if name == "events":
                df = df.withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))
            out = at / f"{name}.parquet" if parts > 1 else at / f"{name}-parts"
            df.repartition(parts).write.parquet(str(out))
            if parts == 1:
                next(out.glob("part-*.parquet")).rename(at / f"{name}.parquet")
        kept = {r["entry_ord"] for r in catalog.QUERIES["stream_dedupe"](spark, str(at)).collect()}
        assert kept == {0, 1, 2, 3, 4, 7}
        assert catalog.QUERIES["stream_weekly_totals"](spark, str(at)).agg(F.sum("articles")).first()[0] == 40
