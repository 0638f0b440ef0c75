"""Queries over content choice, cache, page join and stored model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions.features import article_features
from inkfold.operators.enrich import (
    choose_after_fetch, choose_content, enrich_content, fill_blank, fresh_cache, local_body, parse_response, prompt_rows,
    resolve_enrichment, thin_content, with_cache, with_pages,
)
from inkfold.plans import sql_parts as q
from inkfold.plans.catalog import query
from inkfold.schemas import FEATURES_DDL
from inkfold.session import work_dir
from inkfold.sources.cache import cache_expire, cache_rows, cache_upsert
from inkfold.sources.cache_store import expire_cache_store, read_cache_store, upsert_cache_store
from inkfold.sources.tables import documents_as_articles, pages_as_articles, table

AS_OF = "2024-01-20 00:00:00"


def articles(spark, sf):
    return documents_as_articles(table(spark, sf, "documents"))


_GAPS = f"""gaps AS (SELECT doc_id, split_part(text, chr(10), 1) AS title,
      CASE WHEN lang = 'en' THEN text WHEN lang = 'fr' THEN '' END AS content,
      CASE WHEN lang IN ('fr', 'de') THEN CASE WHEN n_chars > 800 THEN text ELSE '' END END AS full_text,
      CASE WHEN lang = 'de' THEN left(text, 40) WHEN lang = 'fr' THEN left(text, 30) ELSE '' END AS summary,
      CASE WHEN lang = 'en' THEN source END AS source FROM documents)"""


def with_gaps(spark, sf):
    d = table(spark, sf, "documents")
    lang = F.col("lang")
    return d.select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"),
        F.when(lang == "en", F.col("text")).when(lang == "fr", "").alias("content"),
        F.when(lang.isin("fr", "de"), F.when(F.col("n_chars") > 800, F.col("text")).otherwise("")).alias("full_text"),
        F.when(lang == "de", F.substring("text", 1, 40)).when(lang == "fr", F.substring("text", 1, 30)).otherwise("").alias("summary"),
        F.when(lang == "en", F.col("source")).alias("source"),
    )


@query("content_choice", f"""
    WITH {_GAPS} SELECT doc_id, {q.word_count("coalesce(content, '')")} < 50 AS thin,
      md5(coalesce(nullif(content, ''), nullif(full_text, ''), nullif(summary, ''),
                   'Article titled: ' || title || ' from ' || coalesce(source, ''))) AS chosen,
      md5(coalesce(nullif(full_text, ''), nullif(summary, ''), '')) AS local,
      md5(CASE WHEN {q.word_count("coalesce(content, '')")} >= 50 THEN content
               ELSE coalesce(nullif(full_text, ''), nullif(summary, ''), coalesce(content, '')) END) AS after_fetch,
      coalesce(source, '') AS source FROM gaps""")
def content_choice(spark, sf):
    g = with_gaps(spark, sf)
    chosen = g.select(
        "doc_id", thin_content("content").alias("thin"), F.md5(choose_content()).alias("chosen"),
        F.md5(local_body()).alias("local"), F.md5(choose_after_fetch("content")).alias("after_fetch"), "source",
    )
    return fill_blank(chosen)


# A cache in which a document was stored as many hours before 20 January as its id, in two rounds.
_CACHE = """old AS (SELECT 'https://' || source || '.example.com/' || doc_id AS url, 'old ' || n_chars AS content,
      TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR * doc_id AS cached_at FROM documents)"""


def old_cache(spark, sf):
    d = table(spark, sf, "documents")
    small = F.struct(F.col("n_chars").alias("length"), (F.col("lang") == "en").alias("has_code"))
    return d.select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("old "), F.col("n_chars").cast("string")).alias("content"),
        F.to_json(small).alias("features"),
        (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("cached_at"),
    )


def _no_zone(df):
    """The checking SQL has timestamps without zone."""
    return df.withColumn("cached_at", F.col("cached_at").cast("timestamp_ntz"))


@query("cache_read", f"""
    WITH {_CACHE} SELECT url, content, cached_at FROM old WHERE cached_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def cache_read(spark, sf):
    return _no_zone(fresh_cache(old_cache(spark, sf), AS_OF).select("url", "content", "cached_at"))


@query("cache_upsert", f"""
    WITH {_CACHE} SELECT o.url, CASE WHEN l.doc_id IS NULL THEN o.content ELSE 'new' END AS content,
      CASE WHEN l.doc_id IS NULL THEN o.cached_at ELSE TIMESTAMP '{AS_OF}' END AS cached_at
    FROM old o LEFT JOIN (SELECT doc_id, 'https://' || source || '.example.com/' || doc_id AS url
                          FROM labels JOIN documents USING (doc_id)) l USING (url)""")
def cache_upsert_query(spark, sf):
    labelled = articles(spark, sf).join(
        table(spark, sf, "labels").select(F.col("doc_id").alias("entry_ord")), "entry_ord", "left_semi")
    rows = labelled.select("url", F.lit("new").alias("content"), F.lit(None).cast(FEATURES_DDL).alias("features"))
    return _no_zone(cache_upsert(old_cache(spark, sf), cache_rows(rows, AS_OF)).select("url", "content", "cached_at"))


@query("cache_store", f"""
    WITH {_CACHE} SELECT o.url, CASE WHEN l.doc_id IS NULL THEN o.content ELSE 'new' END AS content
    FROM old o LEFT JOIN (SELECT doc_id, 'https://' || source || '.example.com/' || doc_id AS url
                          FROM labels JOIN documents USING (doc_id)) l USING (url)
    WHERE l.doc_id IS NOT NULL OR o.cached_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def cache_store(spark, sf):
    """The same rows through the store of buckets: written, the labelled ones put in anew, old ones dropped, read."""
    folder = work_dir(spark, "cache-store")
    labelled = articles(spark, sf).join(
        table(spark, sf, "labels").select(F.col("doc_id").alias("entry_ord")), "entry_ord", "left_semi")
    rows = labelled.select("url", F.lit("new").alias("content"), F.lit(None).cast(FEATURES_DDL).alias("features"))
    upsert_cache_store(spark, folder, old_cache(spark, sf), buckets=16)
    upsert_cache_store(spark, folder, cache_rows(rows, AS_OF), buckets=16)
    expire_cache_store(spark, folder, AS_OF)
    return read_cache_store(spark, folder).select("url", "content")


@query("cache_expire", f"""
    WITH {_CACHE} SELECT url, cached_at FROM old WHERE cached_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def cache_expire_query(spark, sf):
    return _no_zone(cache_expire(old_cache(spark, sf), AS_OF).select("url", "cached_at"))


@query("features_json", f"""
    WITH {q.ARTICLES} SELECT entry_ord,
      '{{"length":' || length(content) || ',"word_count":' || {q.word_count('content')} || ',"has_code":' || {q.has_code('content')} || '}}' AS features,
      length(content) AS length_back FROM art""")
def features_json(spark, sf):
    f = articles(spark, sf).select("entry_ord", article_features("content", "content", "url").alias("f"))
    text = F.to_json(F.struct("f.length", "f.word_count", "f.has_code"))
    back = F.from_json(F.to_json("f"), FEATURES_DDL)
    return f.select("entry_ord", text.alias("features"), back["length"].alias("length_back"))


@query("with_cache", f"""
    WITH {q.ARTICLES}, {_CACHE}, fresh AS (SELECT * FROM old WHERE cached_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)
    SELECT a.entry_ord, f.url IS NOT NULL AS from_cache, f.content AS cached_content,
           CASE WHEN f.url IS NOT NULL THEN length(a.content) END AS cached_length
    FROM art a LEFT JOIN fresh f USING (url)""")
def with_cache_query(spark, sf):
    joined = with_cache(articles(spark, sf), old_cache(spark, sf), AS_OF)
    return joined.select("entry_ord", "from_cache", "cached_content", F.col("cached_features.length").alias("cached_length"))


@query("with_cache_refresh", f"""
    WITH {q.ARTICLES} SELECT entry_ord, false AS from_cache FROM art""")
def with_cache_refresh(spark, sf):
    return with_cache(articles(spark, sf), old_cache(spark, sf), AS_OF, refresh=True).select("entry_ord", "from_cache")


@query("with_pages", f"""
    WITH {q.PAGE_TEXT}, {q.ARTICLES}, feed AS (
      SELECT feed_ord, entry_ord, url, content, CASE WHEN length(content) < 90 THEN '<p>' || repeat('some words ', 30) || '</p>'
        WHEN length(content) < 150 THEN 'short note' ELSE '' END AS summary, full_text FROM art
      UNION ALL SELECT 2, page_id, url, NULL, '', NULL FROM pages),
    t AS (SELECT *, {q.word_count("coalesce(content, '')")} < 50 AS thin FROM feed)
    SELECT f.feed_ord, f.entry_ord, coalesce(f.thin AND f.summary = '' AND p.page_id IS NOT NULL, false) AS fetched,
      CASE WHEN f.thin AND f.summary LIKE '<p>%' THEN 60 WHEN f.thin AND f.summary <> '' THEN 2
           WHEN f.thin AND p.page_id IS NOT NULL THEN {q.word_count('p.text')} END AS words,
      md5(CASE WHEN NOT f.thin THEN f.content
           WHEN f.summary LIKE '<p>%' THEN trim(repeat('some words ', 30))
           WHEN f.summary <> '' THEN coalesce(nullif(f.full_text, ''), nullif(f.summary, ''))
           WHEN p.page_id IS NULL THEN f.content
           ELSE CASE WHEN {q.word_count('p.text')} >= 50 THEN p.text
                     ELSE coalesce(nullif(f.full_text, ''), nullif(f.summary, ''), p.text) END END) AS content
    FROM t f LEFT JOIN page_text p ON f.url = p.url""")
def with_pages_query(spark, sf):
    p = table(spark, sf, "pages")
    size = F.char_length("content")
    note = (F.when(size < 90, F.concat(F.lit("<p>"), F.repeat(F.lit("some words "), 30), F.lit("</p>")))
            .when(size < 150, "short note").otherwise(""))
    feed = articles(spark, sf).withColumn("summary", note).unionByName(pages_as_articles(p))
    return with_pages(feed, p).select(
        "feed_ord", "entry_ord", "fetched", F.col("features.word_count").alias("words"), F.md5("content").alias("content"))


@query("enrich_content", f"""
    WITH {q.PAGE_TEXT}, stored AS (SELECT url, 'kept ' || length(html) AS content FROM pages
      WHERE TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR * page_id > TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY)
    SELECT p.page_id, CASE WHEN s.url IS NOT NULL THEN 'cache' ELSE 'page' END AS content_from,
           coalesce(s.content, p.text) AS content, length(coalesce(s.content, p.text)) AS length
    FROM page_text p LEFT JOIN stored s USING (url)""")
def enrich_content_query(spark, sf):
    """Pages stored within two days come from the cache, the others are extracted."""
    p = table(spark, sf, "pages")
    kept = F.concat(F.lit("kept "), F.char_length("html").cast("string"))
    cache = p.select(
        "url", kept.alias("content"), F.to_json(F.struct(F.char_length(kept).alias("length"))).alias("features"),
        (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(hours=F.col("page_id").cast("int"))).alias("cached_at"))
    out = enrich_content(pages_as_articles(p), p, cache, AS_OF, days=2)
    return out.select(F.col("entry_ord").alias("page_id"), "content_from", "content", "features.length")


_RESPONSES = """resp AS (SELECT d.doc_id, 'https://' || d.source || '.example.com/' || d.doc_id AS url, l.quality, l.toxic, d.lang, d.source,
      CASE WHEN l.quality = 1 AND l.toxic = 0 THEN
             CASE WHEN d.lang = 'en' THEN '{"category":"Essays","subcategory":"' || d.source || '","formatted_markdown":"md ' || d.doc_id || '","confidence":' || (d.doc_id % 100) / 100 || '}'
                  WHEN d.lang = 'fr' THEN '{"category":"AI","confidence":"0.5"}' ELSE '{"confidence":"high"}' END
           WHEN l.quality = 1 THEN 'Category: Science ' || chr(10) || 'Subcategory: ' || d.source || chr(10) || 'body'
           WHEN l.toxic = 1 THEN 'Subcategory: ' || d.lang || chr(10) || 'Category: AI' || chr(10)
           ELSE 'no label here' END AS response FROM documents d JOIN labels l USING (doc_id))"""


def responses(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    lang, doc = F.col("lang"), F.col("doc_id").cast("string")
    share = ((F.col("doc_id") % 100) / 100).cast("string")
    answer = (
        F.when(lang == "en", F.concat(F.lit('{"category":"Essays","subcategory":"'), "source", F.lit('","formatted_markdown":"md '), doc,
                                      F.lit('","confidence":'), share, F.lit("}")))
        .when(lang == "fr", '{"category":"AI","confidence":"0.5"}').otherwise('{"confidence":"high"}')
    )
    text = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), answer)
        .when(F.col("quality") == 1, F.concat(F.lit("Category: Science \nSubcategory: "), "source", F.lit("\nbody")))
        .when(F.col("toxic") == 1, F.concat(F.lit("Subcategory: "), lang, F.lit("\nCategory: AI\n")))
        .otherwise("no label here")
    )
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), doc)
    return d.select("doc_id", url.alias("url"), text.alias("response"))


_PARSED = """CASE WHEN quality = 1 AND toxic = 0 THEN CASE lang WHEN 'en' THEN 'Essays' WHEN 'fr' THEN 'AI' ELSE 'Unclassified' END
        WHEN quality = 1 THEN 'Science' WHEN toxic = 1 THEN lang END AS r_category,
      CASE WHEN quality = 1 AND toxic = 0 THEN CASE lang WHEN 'en' THEN source ELSE 'N/A' END
        WHEN quality = 1 THEN source WHEN toxic = 1 THEN lang END AS r_subcategory,
      CASE WHEN quality = 1 AND toxic = 0 THEN CASE lang WHEN 'en' THEN 'md ' || doc_id ELSE '' END ELSE response END AS r_markdown,
      CASE WHEN quality = 1 AND toxic = 0 THEN CASE lang WHEN 'en' THEN (doc_id % 100) / 100 WHEN 'fr' THEN 0.5 END END AS r_confidence"""


@query("parse_response", f"""
    WITH {_RESPONSES} SELECT doc_id, quality = 1 AND toxic = 0 AS is_json, false AS other_json, {_PARSED} FROM resp
    UNION ALL
    SELECT -n, n <> 1, n = 1, c, s, m, NULL FROM (VALUES (1, NULL, NULL, '[1]'), (2, 'AI', 'N/A', ''), (3, 'Science', 'two', 'md')) v(n, c, s, m)
    UNION ALL SELECT -4, false, false, NULL, NULL, NULL, NULL""")
def parse_response_query(spark, sf):
    """The answers of the labelled documents, and four odd ones: a list, repeated keys twice, none."""
    odd = ("[1]", '{"category":"Essays","category":"AI"}',
           ' {"subcategory":"one","category":"Science","formatted_markdown":"md","subcategory":"two"}\n', None)
    more = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("string") for x in odd])).alias("i", "response"))
    rows = responses(spark, sf).drop("url").unionByName(
        more.select((-1 - F.col("i")).cast("bigint").alias("doc_id"), "response"))
    return parse_response(rows).drop("response")


@query("resolve_enrichment", f"""
    WITH {q.ARTICLES}, {q.classified(text='content')}, {_RESPONSES},
    p AS (SELECT url, quality = 1 AND toxic = 0 AS is_json, {_PARSED} FROM resp),
    j AS (SELECT c.*, p.url IS NOT NULL AS answered, p.is_json, p.r_category, p.r_subcategory, p.r_markdown, p.r_confidence
          FROM cls c LEFT JOIN p USING (url)),
    final AS (SELECT * EXCLUDE (category, subcategory), category AS rule_category, subcategory AS rule_subcategory,
                     coalesce(r_category, category) AS category FROM j)
    SELECT entry_ord, category, CASE WHEN is_json THEN 'json' WHEN answered THEN 'text' ELSE 'rules' END AS resolved_by,
      coalesce(r_subcategory, CASE WHEN category = rule_category THEN rule_subcategory END) AS subcategory,
      round(CASE WHEN is_json THEN r_confidence WHEN NOT answered THEN category_score END, 9) AS category_score,
      CAST(greatest(1, {q.word_count('content')} // 200) AS BIGINT) AS reading_time, source || '.example.com' AS domain,
      md5(CASE WHEN answered THEN r_markdown ELSE {q.basic_block('content').replace('subcategory', 'rule_subcategory')} END) AS body
    FROM final""")
def resolve_enrichment_query(spark, sf):
    out = resolve_enrichment(articles(spark, sf), responses(spark, sf))
    return out.select(
        "entry_ord", "category", "resolved_by", "subcategory", F.round("category_score", 9).alias("category_score"),
        "reading_time", "domain", F.md5("processed_content").alias("body"),
    )


@query("prompt_rows", f"""
    WITH {q.ARTICLES} SELECT entry_ord, md5('Article Title: ' || title || chr(10) || 'Article URL: ' || url || chr(10) ||
      'Source: ' || source || chr(10) || 'Author: ' || chr(10) || 'Published Date: ' || chr(10) || 'Image URL: ' || chr(10) || chr(10) ||
      'Content:' || chr(10) || content) AS digest FROM art""")
def prompt_rows_query(spark, sf):
    return prompt_rows(articles(spark, sf)).select("entry_ord", F.md5("prompt").alias("digest"))
