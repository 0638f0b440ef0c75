"""Queries over feeds: entries, feed lists, union, limits, de-duplication, run counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions.text import format_published
from inkfold.operators.dedup import (
    dedupe_by_url, duplicate_report, limit_per_feed, only_new, union_feeds,
)
from inkfold.operators.enrich import processed_and_failed
from inkfold.operators.numbering import position
from inkfold.operators.summary import run_summary
from inkfold.plans import sql_parts as q
from inkfold.plans.catalog import query
from inkfold.session import spread, work_dir
from inkfold.sources.feeds import entries_from_column, feed_lines, read_atom
from inkfold.sources.tables import documents_as_articles, pages_as_articles, table
from inkfold.streaming.streams import run_articles


def _xml_text(c):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def entry_xml():
    """A document as an Atom entry."""
    lang = F.col("lang")
    doc = F.col("doc_id").cast("string")

    def when(code, text):
        return F.when(lang == code, text).otherwise(F.lit(""))

    href = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), doc)
    return F.concat(
        F.lit('<entry><title type="html">'), _xml_text(F.substring_index("text", "\n", 1)), F.lit("</title>"),
        F.lit('<link rel="self" href="https://self.example.com/"/>'),
        F.when(lang != "de", F.concat(F.lit('<link rel="alternate" href="'), href, F.lit('"/>'))).otherwise(""),
        F.lit("<published>"), F.when(lang == "en", "2024-01-02T03:04:05Z").otherwise("2024-01-02T03:04:05+00:00"),
        F.lit("</published>"),
        when("en", F.concat(F.lit("<author><name>name "), "source", F.lit("</name></author>"))),
        when("es", F.concat(F.lit("<author><n>n "), "source", F.lit("</n></author>"))),
        F.lit("<source><title>Feed "), F.col("source"), F.lit("</title></source>"),
        when("en", F.concat(F.lit("<summary>sum "), lang, F.lit("</summary>"))),
        F.lit('<content type="html">'), _xml_text(F.col("text")), F.lit("</content>"),
        F.lit('<media:content medium="video" url="https://img.example.com/video'), doc, F.lit('"/>'),
        F.when(lang != "fr", F.concat(
            F.lit('<media:group><media:content medium="image" url="https://img.example.com/pic'), doc,
            F.lit('"/></media:group>'))).otherwise(""),
        F.lit("</entry>"),
    )


@query("atom_entries", f"""
    SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title,
      CASE WHEN lang = 'de' THEN '' ELSE 'https://' || source || '.example.com/' || doc_id END AS url,
      'https://img.example.com/' || CASE WHEN lang = 'fr' THEN 'video' ELSE 'pic' END || doc_id AS image_url,
      CASE WHEN lang = 'es' THEN 'n ' || source WHEN lang = 'en' THEN 'name ' || source END AS author,
      'Feed ' || source AS source,
      CASE WHEN lang = 'en' THEN 'sum ' || lang ELSE '' END AS summary,
      CASE WHEN lang = 'en' THEN 'January 02, 2024' ELSE '2024-01-02T03:04:05+00:00' END AS shown,
      md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS content_digest
    FROM documents""")
def atom_entries(spark, sf):
    """Documents written as Atom entries, then read back through the entry schema."""
    d = spread(table(spark, sf, "documents"))
    a = entries_from_column(d.select("doc_id", entry_xml().alias("xml")), "xml")
    return a.select(
        "doc_id", "title", "url", "image_url", "author", "source", "summary",
        format_published("published").alias("shown"), F.md5("content").alias("content_digest"),
    )


#: Documents of one feed file, and one entry of how many is malformed.
FEED_DOCS, ONE_BAD_OF = 250, 11


def written_feeds(spark, sf):
    """Documents as feed files of so many each, in the order of their ids; the entries of some have a wrong end tag.

    Returns the folder; its feeds are ``feed=N/part-*``."""
    out = work_dir(spark, "feeds")
    feed = F.lpad(F.expr(f"doc_id div {FEED_DOCS}").cast("string"), 12, "0").alias("feed")
    xml = F.when(F.col("doc_id") % ONE_BAD_OF == 5, F.replace(entry_xml(), F.lit("</title><link"), F.lit("</ttle><link"))).otherwise(entry_xml())
    d = spread(table(spark, sf, "documents")).select(feed, F.col("doc_id").alias("at"), xml.alias("value"))
    head = F.lit('<?xml version="1.0"?>\n<feed xmlns="http://www.w3.org/2005/Atom">')
    feeds = d.groupBy("feed").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    lines = (d.unionByName(feeds.select("feed", (F.col("low") - 1).alias("at"), head.alias("value")))
             .unionByName(feeds.select("feed", (F.col("high") + 1).alias("at"), F.lit("</feed>").alias("value"))))
    lines.repartition("feed").sortWithinPartitions("feed", "at").select("feed", "value").write.partitionBy("feed").text(out)
    return out


@query("feed_files", f"""
    WITH f AS (
      SELECT dense_rank() OVER (ORDER BY doc_id // {FEED_DOCS}) AS feed_ord,
             row_number() OVER (PARTITION BY doc_id // {FEED_DOCS} ORDER BY doc_id) AS entry_ord,
             count(*) FILTER (doc_id % {ONE_BAD_OF} = 5) OVER (PARTITION BY doc_id // {FEED_DOCS}) AS corrupt_records, *
      FROM documents)
    SELECT feed_ord, entry_ord, corrupt_records, trim(split_part(text, chr(10), 1)) AS title, 'Feed ' || source AS source,
           md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS content_digest
    FROM f WHERE doc_id % {ONE_BAD_OF} <> 5""")
def feed_files(spark, sf):
    """Documents written to feed files, and the files read back in pieces, numbered, malformed entries left out."""
    a = read_atom(spark, [f"{written_feeds(spark, sf)}/feed=*"])
    return a.select("feed_ord", "entry_ord", "corrupt_records", "title", "source", F.md5("content").alias("content_digest"))


@query("stream_feed_files", f"""
    SELECT doc_id % {ONE_BAD_OF} <> 5 AS good, CASE WHEN doc_id % {ONE_BAD_OF} = 5 THEN NULL ELSE 'Feed ' || source END AS source,
           CASE WHEN doc_id % {ONE_BAD_OF} <> 5 THEN md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) END AS content_digest
    FROM documents""")
def stream_feed_files(spark, sf):
    """The same files as a stream into a table of articles and one of malformed entries; started twice, read once."""
    feeds, out = written_feeds(spark, sf), work_dir(spark, "feed-stream")
    for _ in range(2):
        run_articles(spark, f"{feeds}/feed=*", out, f"{out}/log", glob="part-*").awaitTermination()
    good = spark.read.parquet(f"{out}/articles").select(F.lit(True).alias("good"), "source", F.md5("content").alias("content_digest"))
    bad = spark.read.parquet(f"{out}/corrupt").filter(F.col("raw").startswith("<entry>"))
    none = F.lit(None).cast("string")
    return good.unionByName(bad.select(F.lit(False).alias("good"), none.alias("source"), none.alias("content_digest")))


@query("feed_list", f"""
    WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line,
                      generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) AS feed_ord FROM documents)
    SELECT doc_id, feed_ord, {q.strip('line')} AS feed_url FROM l
    WHERE {q.strip('line')} <> '' AND NOT starts_with({q.strip('line')}, '#')""")
def feed_list(spark, sf):
    return feed_lines(spread(table(spark, sf, "documents").select("doc_id", "text")), "text")


_ONE_FEED = f"""{q.ARTICLES}, two AS (
    SELECT feed_ord, entry_ord, 'https://d.example.com/' || md5(full_text) AS url FROM art
    UNION ALL SELECT 2, page_id, CASE WHEN contains(url, '?') THEN NULL ELSE url END FROM pages
    UNION ALL SELECT 3, entry_ord, 'https://d.example.com/' || md5(full_text) FROM art)"""


def two_feeds(spark, sf):
    """Documents by content address, pages (some without URL), and the documents once more."""
    docs = documents_as_articles(table(spark, sf, "documents"))
    docs = docs.withColumn("url", F.concat(F.lit("https://d.example.com/"), F.md5("full_text")))
    pages = pages_as_articles(table(spark, sf, "pages"))
    pages = pages.withColumn("url", F.when(~F.contains("url", F.lit("?")), F.col("url")))
    return union_feeds(docs, pages, docs.withColumn("feed_ord", F.lit(3).cast("bigint")))


@query("union_feeds", f"WITH {_ONE_FEED} SELECT feed_ord, entry_ord, url FROM two")
def union_feeds_query(spark, sf):
    return two_feeds(spark, sf).select("feed_ord", "entry_ord", "url")


_RANKED = f"""WITH {_ONE_FEED}, r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(url, feed_ord || ':' || entry_ord)
      ORDER BY feed_ord, entry_ord) AS rk FROM two) SELECT feed_ord, entry_ord, url FROM r"""


@query("dedupe_by_url", f"{_RANKED} WHERE rk = 1")
def dedupe_by_url_query(spark, sf):
    return dedupe_by_url(two_feeds(spark, sf)).select("feed_ord", "entry_ord", "url")


@query("dedupe_by_url_empty_is_one", f"""
    WITH {_ONE_FEED}, r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(url, '') ORDER BY feed_ord, entry_ord) AS rk FROM two)
    SELECT feed_ord, entry_ord, url FROM r WHERE rk = 1""")
def dedupe_by_url_empty_is_one(spark, sf):
    return dedupe_by_url(two_feeds(spark, sf), empty_is_one=True).select("feed_ord", "entry_ord", "url")


@query("duplicate_report", f"{_RANKED} WHERE rk > 1")
def duplicate_report_query(spark, sf):
    return duplicate_report(two_feeds(spark, sf)).select("feed_ord", "entry_ord", "url")


@query("limit_per_feed", """
    SELECT source, doc_id, entry_ord FROM (SELECT source, doc_id,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) AS entry_ord FROM documents) WHERE entry_ord <= 7""")
def limit_per_feed_query(spark, sf):
    """Every source is a feed; the entry order inside it comes from block-wise numbering."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.lit(0).alias("one"))
    return limit_per_feed(position(d, ["source"], "entry_ord", ("one", "doc_id"), block_rows=64), 7).drop("one")


@query("only_new", """
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def only_new_query(spark, sf):
    a = documents_as_articles(table(spark, sf, "documents"))
    sent = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"))
    return only_new(a, sent).select(F.col("entry_ord").alias("doc_id"))


@query("processed_and_failed", f"""
    SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' ELSE 'processed' END AS status,
           CASE WHEN toxic = 1 THEN 'Unclassified' ELSE 'Kept' END AS category,
           CASE WHEN toxic = 1 THEN '**Note: Full article content could not be retrieved.**' ELSE md5(text) END AS body
    FROM documents LEFT JOIN labels USING (doc_id)""")
def processed_and_failed_query(spark, sf):
    a = documents_as_articles(table(spark, sf, "documents")).withColumns(
        {"category": F.lit("Kept"), "content": F.md5("content"), "processed_content": F.md5("content")})
    a = a.join(table(spark, sf, "labels").withColumnRenamed("doc_id", "entry_ord"), "entry_ord", "left")
    failed = F.coalesce(F.col("toxic") == 1, F.lit(False))
    both = processed_and_failed(a.filter(~failed), a.filter(failed))
    return both.select(F.col("entry_ord").alias("doc_id"), "status", "category", F.col("processed_content").alias("body"))


@query("run_summary", f"""
    WITH {_ONE_FEED}, r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(url, feed_ord || ':' || entry_ord)
      ORDER BY feed_ord, entry_ord) AS rk, CASE WHEN url IS NULL THEN 'failed' ELSE 'processed' END AS status FROM two)
    SELECT feed_ord, count(*) AS entries, count(*) FILTER (rk = 1) AS unique_entries, count(*) FILTER (rk > 1) AS duplicates,
           count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'failed') AS failed
    FROM r GROUP BY feed_ord""")
def run_summary_query(spark, sf):
    status = F.when(F.col("url").isNull(), "failed").otherwise("processed")
    return run_summary(two_feeds(spark, sf).withColumn("status", status))
