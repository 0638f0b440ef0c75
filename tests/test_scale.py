"""Plans, skew and properties that have to hold at any size."""

import random

from pyspark.sql import functions as F

from inkfold.operators.budget import word_budget
from inkfold.operators.classify import classify_articles
from inkfold.operators.dedup import dedupe_by_url, duplicate_report
from inkfold.operators.extract import extract_text
from inkfold.operators.health import fold_summaries, log_summaries, source_health
from inkfold.operators.keywords import top_keywords
from inkfold.operators.numbering import position, running_total
from inkfold.plans import catalog
from inkfold.sources.tables import documents_as_articles, table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored_articles(spark, tmp_path):
    path = str(tmp_path / "articles")
    documents_as_articles(table(spark, SF, "documents")).write.parquet(path)
    return spark.read.parquet(path)


def test_classification_stays_in_the_jvm_and_does_not_shuffle(spark, tmp_path):
    p = plan(classify_articles(stored_articles(spark, tmp_path)).select("category", "subcategory"))
    assert "Python" not in p and "Exchange" not in p and "Join" not in p


def test_scan_reads_only_needed_columns(spark, tmp_path):
    a = stored_articles(spark, tmp_path)
    p = plan(dedupe_by_url(a.select("url", "feed_ord", "entry_ord")))
    assert "full_text" not in p
    assert "Exchange" not in plan(top_keywords(a.select("full_text"), "full_text"))


def test_dedupe_is_one_shuffle_with_a_limit_before_it(spark, tmp_path):
    p = plan(dedupe_by_url(stored_articles(spark, tmp_path)))
    assert p.count("Exchange hashpartitioning") == 1
    assert "Partial" in p and "WindowGroupLimit" in p


def test_easy_pages_need_no_python(spark):
    assert "Python" not in plan(extract_text(table(spark, SF, "pages"), tree=False))


def test_no_cartesian_product(spark):
    catalog.load()
    for name in ("contents", "newsletter", "marked_reading_list", "with_pages", "resolve_enrichment", "source_health"):
        p = plan(catalog.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def skewed(spark, n=6000):
    """A third of the rows share one URL, a third have none."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        url = "hot" if i % 3 == 0 else None if i % 3 == 1 else f"u{rng.randrange(900)}"
        rows.append((i % 5 + 1, i // 5 + 1, url))
    return spark.createDataFrame(rows, "feed_ord long, entry_ord long, url string"), rows


def test_dedupe_with_hot_and_missing_urls(spark):
    df, rows = skewed(spark)
    first = {}
    for feed, entry, url in sorted(rows, key=lambda r: r[:2]):
        first.setdefault(url if url is not None else (feed, entry), (feed, entry))
    kept = {(r["feed_ord"], r["entry_ord"]) for r in dedupe_by_url(df).collect()}
    dropped = {(r["feed_ord"], r["entry_ord"]) for r in duplicate_report(df).collect()}
    assert kept == set(first.values())
    assert dropped == {r[:2] for r in rows} - kept
    again = dedupe_by_url(dedupe_by_url(df.repartition(13)))
    assert {(r["feed_ord"], r["entry_ord"]) for r in again.collect()} == kept


def test_positions_in_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", rng.randrange(40), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, feed long, entry long").repartition(7)
    got = {(r["feed"], r["entry"]): r["p"] for r in position(df, ["k"], "p", ("feed", "entry"), block_rows=64, block_feeds=3).collect()}
    expect, seen = {}, {}
    for k, feed, entry in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        expect[(feed, entry)] = seen[k]
    assert got == expect
    total = running_total(df, ["k"], F.col("entry"), "t", ("feed", "entry"), block_rows=64).groupBy("k").agg(F.max("t").alias("m"))
    assert {r["k"]: r["m"] for r in total.collect()} == {
        k: sum(e for kk, _, e in rows if kk == k) for k in {r[0] for r in rows}}


def test_word_budget_never_exceeds_the_limit(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 2 else f"k{i % 7}", i, " ".join("w" * rng.randrange(0, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, pos long, p string")
    got = word_budget(df, "k", "pos", "p", 50).groupBy("k").agg(F.sum(F.size(F.split("p", " "))).alias("n"))
    assert all(r["n"] <= 51 for r in got.collect())


def fold(events):
    state = {}
    for domain, _, _, ok in sorted(events, key=lambda e: (e[1], e[2])):
        fails, backoff = state.get(domain, (0, 1.0))
        if ok:
            fails, backoff = 0, max(1.0, backoff * 0.8) if backoff > 1 else backoff
        else:
            fails += 1
            backoff = min(60.0, backoff * 2) if fails >= 3 else backoff
        state[domain] = (fails, backoff)
    return state


def test_source_health_is_the_same_for_any_split(spark):
    rng = random.Random(11)
    events = [("hot" if rng.random() < 0.5 else f"d{rng.randrange(6)}", i // 3, i, rng.random() < 0.45) for i in range(4000)]
    events += [("dead", i, 5000 + i, False) for i in range(1500)] + [("four", i, 9000 + i, i == 4) for i in range(5)]
    log = spark.createDataFrame(events, "domain string, t long, event_id long, ok boolean").select(
        "domain", F.timestamp_seconds("t").alias("ts"), "event_id", "ok")
    expect = fold(events)
    for parts in (1, 4, 23):
        got = {r["domain"]: r for r in source_health(log, parts).collect()}
        assert set(got) == set(expect)
        for d, (fails, backoff) in expect.items():
            assert got[d]["failures"] == fails and abs(got[d]["backoff"] - backoff) < 1e-9
    assert abs(expect["four"][1] - 3.2) < 1e-9
    early = fold_summaries(log_summaries(log.filter("event_id < 2000"), 5))
    late = fold_summaries(log_summaries(log.filter("event_id >= 2000"), 5), early)
    got = {r["domain"]: (r["failures"], round(r["backoff"], 9)) for r in late.collect()}
    assert got == {d: (f, round(b, 9)) for d, (f, b) in fold(
        [(d, (0 if i < 2000 else 10**6) + t, i, ok) for d, t, i, ok in events]).items()}


def test_every_article_has_one_category_and_digest_counts_agree(spark):
    catalog.load()
    counts = catalog.QUERIES["category_counts"](spark, SF).agg(F.sum("articles")).first()[0]
    assert counts == table(spark, SF, "documents").count()
    blocks = catalog.QUERIES["newsletter"](spark, SF).filter("part = 3 and entry_ord >= 0").count()
    assert blocks == counts
    bad = catalog.QUERIES["classify"](spark, SF).filter("category is null or category_score < 0 or category_score > 1")
    assert bad.count() == 0
