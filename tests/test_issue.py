"""From articles to digest files, and cache snapshots."""

from pathlib import Path

from pyspark.sql import functions as F

from inkfold.operators import digest
from inkfold.plans.issue import DIGESTS, build_issue, process_articles
from inkfold.schemas import DIGEST_ORDER, FEATURES_DDL
from inkfold.sources.cache import cache_rows, cache_upsert, read_cache, write_cache
from inkfold.sources.cache_store import expire_cache_store, manifest, read_cache_store, upsert_cache_store

COLUMNS = ("feed_ord long, entry_ord long, title string, url string, image_url string, author string, source string, "
           "summary string, read_more_url string, published string, full_text string, content string")


def articles(spark):
    rows = [
        (1, 1, "Python tips", "https://a.com/1", None, "Ann", "S1", "", "https://a.com/1", "2025-02-06T18:40:50Z", "python python code", None),
        (1, 2, "On gpt", "https://ft.com/2", "img", None, "S2", "short gpt", "https://ft.com/2", None, None, None),
        (1, 3, "Copy", "https://a.com/1", None, None, None, "", None, None, "python", None),
        (2, 1, "Bias", "https://a.com/3", None, None, None, "", "https://a.com/3", "later", "gpt " + "bias " * 10, "<p>gpt bias</p>"),
        (2, 2, "zzz", "", None, None, None, "", None, None, "", None),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def text_of(folder: str) -> str:
    files = sorted(Path(folder).rglob("part-*.txt"))
    return "".join(f.read_text() for f in files)


def test_documents(spark, tmp_path):
    table = build_issue(spark, articles(spark), "2025-02-07", str(tmp_path / "out"), html=True)
    assert table.count() == 4
    block = ("### [Python tips](https://a.com/1)\n\n**Author:** Ann\n**Source:** S1\n**Published:** February 06, 2025\n"
             "**Classification:** Programming\n**Subcategory:** Languages\n\npython python code\n\n[Read more](https://a.com/1)\n")
    md = text_of(f"{tmp_path}/out/md/newsletter")
    assert md.startswith("# Weekly Digest\n\nGenerated on February 07, 2025\n\n## In This Issue\n\n"
                         "- AI: 2 articles\n- Other: 1 articles\n- Programming: 1 articles\n\n---\n\n## AI\n\n### [On gpt](https://ft.com/2)\n")
    assert md.endswith("## Programming\n\n" + block + "\n---\n\n")
    assert md.index("[On gpt]") < md.index("[Bias]") < md.index("## Other")
    assert text_of(f"{tmp_path}/out/md/reading_list") == (
        "# Weekly Digest - Reading List\n\nGenerated on February 07, 2025\n\n## AI\n\n- [On gpt](https://ft.com/2)\n- [Bias](https://a.com/3)\n\n"
        "## Other\n\n- [zzz]()\n\n## Programming\n\n- [Python tips](https://a.com/1)\n\n")
    page = text_of(f"{tmp_path}/out/html/reading_list")
    assert page.startswith("<!DOCTYPE html>\n<html>\n<body>\n<h1>Weekly") and page.endswith("</body>\n</html>\n")
    assert '<li><a href="https://ft.com/2">On gpt</a></li>' in page
    news = text_of(f"{tmp_path}/out/html/newsletter")
    assert "<li>AI: 2 articles</li>" in news and "<hr>" in news and "<p>python python code</p>" in news
    assert not [x for x in (page + news).split("\n") if x.startswith(("#", "- ", "---"))]


def lines(df):
    return [r["line"] for r in df.orderBy(*DIGEST_ORDER).collect()]


def test_contents_and_lists(spark):
    done = process_articles(articles(spark).filter("title <> 'Copy'"), "2025-02-07").cache()
    text = lines(digest.contents(done))
    assert text[1:] == [
        "1. [AI](#ai)", "   1.1. [AI Ethics](#ai-ethics)", "   1.2. [LLMs](#llms)", "2. [Other](#other)",
        "3. [Programming](#programming)", "   3.1. [Languages](#languages)", "",
        "## 1. AI", "### 1.1. AI Ethics", "1.1.1. [Bias](https://a.com/3)", "", "### 1.2. LLMs", "1.2.1. [On gpt](https://ft.com/2)", "",
        "## 2. Other", "2.1. [zzz]()", "", "## 3. Programming", "### 3.1. Languages", "3.1.1. [Python tips](https://a.com/1)", ""]
    marked = lines(digest.marked_reading_list(done))
    assert marked[0].endswith("\n*Note: 1 article may be behind a paywall.*\n")
    assert marked[1:4] == ["## AI", "- [On gpt](https://ft.com/2) \N{LOCK}", "- [Bias](https://a.com/3)"]
    single = lines(digest.marked_reading_list(done.filter("category = 'AI'")))
    assert single[1:] == marked[2:4]
    unnamed = done.withColumn("category", F.when(F.col("category") == "AI", "").otherwise(F.col("category")))
    heads = [x for x in lines(digest.snippets(unnamed)) if x.startswith("## ")]
    assert heads == ["## Other\n", "## Programming\n", "## Uncategorized\n"]
    sections = lines(digest.sectioned_newsletter(done))
    assert [x for x in sections if x.startswith(("## ", "### LLM", "### AI", "### Lang"))] == [
        "## AI", "### LLMs", "### AI Ethics", "## Other", "## Programming", "### Languages"]


def test_articles_without_category_are_kept(spark):
    done = process_articles(articles(spark).filter("title <> 'Copy'"), "2025-02-07")
    done = done.withColumn("category", F.when(F.col("category") != "AI", F.col("category"))).cache()
    assert digest.number_contents(done).count() == 4
    for make in (digest.newsletter, digest.contents, digest.reading_list):
        assert sum("On gpt" in x for x in lines(make(done))) == 1
    assert "3. [Unclassified](#unclassified)" in lines(digest.contents(done))


def test_cache_snapshots(spark, tmp_path):
    def rows(pairs, at):
        df = spark.createDataFrame(pairs, "url string, content string").withColumn("features", F.lit(None).cast(FEATURES_DDL))
        return cache_rows(df, at)

    first = rows([("a", "1"), ("b", "1"), (None, "x"), ("", "y")], "2025-01-01")
    write_cache(first, str(tmp_path / "v1"))
    second = cache_upsert(read_cache(spark, str(tmp_path / "v1")), rows([("b", "2"), ("c", "2")], "2025-01-05"))
    assert sorted((r["url"], r["content"]) for r in second.collect()) == [("a", "1"), ("b", "2"), ("c", "2")]


def test_cache_store_writes_what_it_touches(spark, tmp_path):
    folder = str(tmp_path / "store")

    def rows(ids, content, at):
        df = spark.createDataFrame([(f"u{i}", content) for i in ids], "url string, content string")
        return cache_rows(df.withColumn("features", F.lit(None).cast(FEATURES_DDL)), at)

    held = lambda v=None: {r["url"]: r["content"] for r in read_cache_store(spark, folder, v).collect()}
    assert held() == {}
    assert upsert_cache_store(spark, folder, rows(range(400), "1", "2025-01-01"), buckets=32) == 1
    first = {r["bucket"]: r["write"] for r in manifest(spark, folder).collect()}
    assert len(first) == 32
    before = read_cache_store(spark, folder)
    assert upsert_cache_store(spark, folder, rows([7, 900], "2", "2025-01-06"), buckets=32) == 2
    second = {r["bucket"]: r["write"] for r in manifest(spark, folder).collect()}
    assert 1 <= sum(second[b] != first[b] for b in first) <= 2
    want = {f"u{i}": "1" for i in range(400)}
    assert held(1) == want == {r["url"]: r["content"] for r in before.collect()}
    assert held() == want | {"u7": "2", "u900": "2"}
    # a write without a manifest belongs to no version; nor does a manifest that is not whole
    cache = rows([1], "lost", "2025-01-07").withColumns({"bucket": F.lit(3), "write": F.lit("x")})
    cache.write.mode("append").partitionBy("bucket", "write").parquet(f"{folder}/data")
    (tmp_path / "store" / "manifest" / "version=3").mkdir()
    assert held() == want | {"u7": "2", "u900": "2"}
    (tmp_path / "store" / "manifest" / "version=3").rmdir()
    assert expire_cache_store(spark, folder, "2025-01-05") is None
    assert expire_cache_store(spark, folder, "2025-01-09") == 3
    assert held() == {"u7": "2", "u900": "2"}
    assert upsert_cache_store(spark, folder, rows([], "", "2025-01-09"), buckets=32) == 4 and len(held()) == 2


def test_all_kinds_with_pages_cache_and_responses(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.com/1", "<article><p>" + "word " * 60 + "</p></article>")] * 2, "url string, html string")
    cache = cache_rows(spark.createDataFrame([("https://ft.com/2", "stored " * 60)], "url string, content string")
                       .withColumn("features", F.lit(None).cast(FEATURES_DDL)), "2025-02-06")
    answers = spark.createDataFrame([("https://a.com/3", '{"category": "Science", "formatted_markdown": "Bias, retold"}')], "url string, response string")
    table = build_issue(spark, articles(spark), "2025-02-07", str(tmp_path / "out"), kinds=tuple(DIGESTS), pages=pages, cache=cache,
                        as_of="2025-02-07", responses=answers, features=True)
    rows = {r["title"]: r for r in table.collect()}
    assert len(rows) == table.count() == 4
    assert rows["Python tips"]["content"].startswith("word word") and rows["On gpt"]["content"].startswith("stored")
    assert rows["Bias"]["category"] == "Science" and rows["Bias"]["features"]["word_count"] == 11
    for kind in DIGESTS:
        assert "Bias" in text_of(f"{tmp_path}/out/md/{kind}")
