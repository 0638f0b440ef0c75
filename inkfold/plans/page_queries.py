"""Queries over stored pages: cleaning, text, images, features, word-limited blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions.html import (
    block_texts, link_count, main_content, scrub_html, strip_boilerplate,
)
from inkfold.functions.features import article_features
from inkfold.operators.budget import truncate_html_words
from inkfold.operators.extract import extract_paragraphs, extract_text, process_pages, with_images
from inkfold.plans import sql_parts as q
from inkfold.plans.catalog import query
from inkfold.session import spread
from inkfold.sources.tables import read_pages, table


def pages(spark, sf):
    return spread(table(spark, sf, "pages"))


@query("read_pages", """
    SELECT page_id, url, length(html) AS n_chars,
           regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1) AS domain FROM pages""")
def read_pages_query(spark, sf):
    p = read_pages(spark, f"{sf}/pages.parquet")
    return p.select("page_id", "url", F.char_length("html").cast("bigint").alias("n_chars"), "domain")


@query("strip_boilerplate", f"WITH {q.CLEAN_PAGES} SELECT page_id, md5(page) AS digest FROM clean")
def strip_boilerplate_query(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(strip_boilerplate("html")).alias("digest"))


@query("main_content", f"WITH {q.MAIN_PAGES} SELECT page_id, md5(part) AS digest FROM main")
def main_content_query(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(main_content(strip_boilerplate("html"))).alias("digest"))


@query("block_texts", f"""
    WITH {q.PAGE_BLOCKS}
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, block FROM blocks""")
def block_texts_query(spark, sf):
    blocks = block_texts(main_content(strip_boilerplate("html")))
    # The outer form keeps the size filter of the inner one from computing the blocks twice.
    rows = pages(spark, sf).select("page_id", F.posexplode_outer(blocks).alias("pos", "block"))
    return rows.filter(F.col("block").isNotNull()).withColumn("pos", F.col("pos").cast("bigint"))


@query("scrub_html", f"SELECT page_id, md5({q.scrub('html')}) AS digest, "
       f"md5({q.scrub("replace(html, '<html', '<main')")}) AS inner_digest FROM pages")
def scrub_html_query(spark, sf):
    """Whole pages, which are one wrapped document, and the same without that, so that the inner rules show."""
    inner = F.replace("html", F.lit("<html"), F.lit("<main"))
    return pages(spark, sf).select(
        "page_id", F.md5(scrub_html("html")).alias("digest"), F.md5(scrub_html(inner)).alias("inner_digest")
    )


@query("extract_text", f"WITH {q.PAGE_TEXT} SELECT page_id, text FROM page_text")
def extract_text_query(spark, sf):
    return extract_text(pages(spark, sf)).select("page_id", "text")


@query("link_count", "SELECT page_id, (length(html) - length(replace(html, 'href=', ''))) // 5 AS links FROM pages")
def link_count_query(spark, sf):
    return pages(spark, sf).select("page_id", link_count("html").alias("links"))


@query("extract_images", """
    SELECT page_id, pos, CASE WHEN pos = 0 THEN url || '/a.png' ELSE url || '/b.png' END AS src,
           CASE WHEN pos = 0 THEN 'first & best' ELSE '' END AS alt,
           CASE WHEN pos = 0 THEN '640' ELSE '49' END AS width, CASE WHEN pos = 0 THEN '480' ELSE '50' END AS height
    FROM pages, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS pos)""")
def extract_images_query(spark, sf):
    p = pages(spark, sf)
    tags = F.concat(
        F.lit('<img src="'), "url", F.lit('/a.png" alt="first &amp; best" width="640" height="480">'),
        F.lit("<IMG width=10 height='10' src='"), "url", F.lit("/icon.png'>"),
        F.lit('<img alt="no source"><img src="'), "url", F.lit('/b.png" width=49 height=50/>'),
        F.lit('<img src="'), "url", F.lit('/a.png">'),
    )
    with_tags = p.withColumn("html", F.replace("html", F.lit("</article>"), F.concat(tags, F.lit("</article>"))))
    found = with_images(with_tags).select("page_id", F.posexplode("images").alias("pos", "i"))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "i.src", "i.alt", "i.width",
                        F.regexp_replace("i.height", "/$", "").alias("height"))


def _feature_sql(text: str, html: str, url: str) -> str:
    return f"""length({text}) AS length, {q.word_count(text)} AS word_count, {q.has_code(text)} AS has_code,
        CAST(3 * {q.occurrences(text, '"')} AS BIGINT) AS has_quotes,
        CAST({q.occurrences(text, '"')} AS BIGINT) AS quote_count,
        CAST(len({q.sentences(text)}) AS BIGINT) AS sentence_count,
        CAST({q.occurrences(html, 'href=')} AS BIGINT) AS link_count,
        CAST(greatest(1, {q.word_count(text)} // 200) AS BIGINT) AS reading_time,
        {q.technical_terms(text)} AS technical_terms, {q.lead_summary(text)} AS summary,
        {q.paywalled(text, url)} AS paywall_detected"""


FEATURE_COLUMNS = ["length", "word_count", "has_code", "has_quotes", "quote_count", "sentence_count",
                   "link_count", "reading_time", "technical_terms", "summary", "paywall_detected"]


@query("page_features", f"WITH {q.PAGE_TEXT} SELECT page_id, {_feature_sql('text', 'html', 'url')} FROM page_text")
def page_features(spark, sf):
    return process_pages(pages(spark, sf)).select("page_id", *[f"features.{c}" for c in FEATURE_COLUMNS])


@query("article_features", f"""
    WITH {q.ARTICLES}, n AS (SELECT entry_ord, url, content, {q.normalize('content')} AS t FROM art)
    SELECT entry_ord, {_feature_sql('t', 'content', 'url')} FROM n""")
def article_features_query(spark, sf):
    from inkfold.functions.text import normalize_ws
    from inkfold.sources.tables import documents_as_articles

    a = documents_as_articles(table(spark, sf, "documents")).withColumn("t", normalize_ws("content"))
    f = a.select("entry_ord", article_features("t", "content", "url").alias("f"))
    return f.select("entry_ord", *[f"f.{c}" for c in FEATURE_COLUMNS])


_PIECE = "'^(<(p|h1)[^>]*>.*?</(?:p|h1)>)'"


@query("extract_html_blocks", f"""
    WITH {q.MAIN_PAGES.replace(', main AS', ', main0 AS')},
    main AS (SELECT page_id, replace(replace(part, '<p>', '<p class="t">'), '<br>', '<br/>') AS part FROM main0),
    piece AS (SELECT page_id, unnest(string_split(regexp_replace({q.scrub('part')}, '(<(?:p|h1)(?:\\s[^>]*)?>)', chr(1) || '\\1', 'gi'), chr(1))) AS s,
                     generate_subscripts(string_split(regexp_replace({q.scrub('part')}, '(<(?:p|h1)(?:\\s[^>]*)?>)', chr(1) || '\\1', 'gi'), chr(1)), 1) AS i
              FROM main),
    blk AS (SELECT page_id, i, CASE WHEN regexp_matches(s, {_PIECE}, 's') THEN regexp_extract(s, {_PIECE}, 1, 's') ELSE s END AS source,
                   regexp_extract(s, '^<(p|h1)', 1) AS tag, regexp_extract(s, '^(<[^>]*>)', 1) AS opening
            FROM piece WHERE regexp_matches(s, '^<(p|h1)')),
    n AS (SELECT *, regexp_replace(source, '<[^>]*>', ' ', 'g') AS words,
                 {q.word_count("regexp_replace(source, '<[^>]*>', ' ', 'g')")} AS n FROM blk),
    r AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY i) AS run FROM n),
    first_over AS (SELECT page_id, min(i) AS stop FROM r WHERE run > 200 GROUP BY page_id),
    k AS (SELECT r.page_id, r.i, CASE WHEN run <= 200 THEN source ELSE
             opening || array_to_string(({q.word_list('words')})[1:CAST(200 - (run - n) AS BIGINT)], ' ') || '...</' || tag || '>' END AS html
          FROM r LEFT JOIN first_over f USING (page_id)
          WHERE (f.stop IS NULL OR r.i <= f.stop) AND (run <= 200 OR (tag = 'p' AND run - n < 200)))
    SELECT m.page_id, coalesce(string_agg(k.html || chr(10) || chr(10), '' ORDER BY k.i), '') AS extracted
    FROM main m LEFT JOIN k USING (page_id) GROUP BY m.page_id""")
def extract_html_blocks(spark, sf):
    # Bare "<p><b>" counts as malformed and would be taken as plain text.
    part = main_content(strip_boilerplate("html"))
    part = F.replace(F.replace(part, F.lit("<p>"), F.lit('<p class="t">')), F.lit("<br>"), F.lit("<br/>"))
    p = pages(spark, sf).select("page_id", part.alias("part"))
    return extract_paragraphs(p, "part", 200).select("page_id", "extracted")


_VOID = "'^<(!|(img|br|hr|meta|link|input|source|wbr)([^a-z0-9_]|$))|/>$'"


@query("truncate_html_words", f"""
    WITH RECURSIVE {q.MAIN_PAGES},
    tok AS (SELECT page_id, regexp_extract_all(part, '<[^>]*>|[^<]+') AS ts FROM main),
    step AS (SELECT page_id, 0::BIGINT AS i, 0::BIGINT AS run, []::VARCHAR[] AS open, '' AS html FROM tok
      UNION ALL
      SELECT page_id, i + 1, CASE WHEN tag OR run >= 100 THEN run ELSE least(100, run + n) END,
             CASE WHEN pops THEN open[1:len(open) - 1] WHEN run < 100 AND tag AND NOT closes AND NOT empty AND name <> '' THEN open || [name] ELSE open END,
             html || CASE WHEN pops THEN t WHEN run >= 100 THEN '' WHEN tag OR run + n <= 100 THEN t
                          ELSE array_to_string(w[1:100 - run], ' ') END
      FROM (SELECT *, closes AND len(open) > 0 AND open[len(open)] = name AS pops, len(w) AS n FROM (
        SELECT step.*, ts[i + 1] AS t, starts_with(ts[i + 1], '<') AS tag, starts_with(ts[i + 1], '</') AS closes,
               lower(regexp_extract(ts[i + 1], '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name,
               regexp_matches(lower(ts[i + 1]), {_VOID}) AS empty, {q.word_list('ts[i + 1]')} AS w
        FROM step JOIN tok USING (page_id) WHERE i < len(ts))))
    SELECT m.page_id, s.html || coalesce('</' || nullif(array_to_string(list_reverse(s.open), '></'), '') || '>', '') AS html
    FROM main m JOIN tok USING (page_id) JOIN step s ON s.page_id = m.page_id AND s.i = len(tok.ts)""")
def truncate_html_words_query(spark, sf):
    p = pages(spark, sf).select("page_id", main_content(strip_boilerplate("html")).alias("part"))
    return p.select("page_id", truncate_html_words("part", 100).alias("html"))
