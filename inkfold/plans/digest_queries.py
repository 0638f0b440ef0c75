"""Queries over issue counts, numbering, blocks and rendered digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions.blocks import block_basic, block_full, block_original, metadata_line, metadata_lines, metadata_tabs
from inkfold.operators import digest
from inkfold.operators.enrich import local_body
from inkfold.operators.extract import extract_paragraphs
from inkfold.operators.summary import category_counts, paywalled_count, subcategory_groups
from inkfold.plans import sql_parts as q
from inkfold.plans.catalog import query
from inkfold.plans.issue import process_articles
from inkfold.plans.text_queries import _KIND, _LINES, _SPACED
from inkfold.session import work_dir, written
from inkfold.sources.sinks import conversion_status, html_lines, write_digest_md
from inkfold.sources.tables import documents_as_articles, table

ISSUES = {"en": "2024-02-05", "other": "2024-02-12"}


def processed_documents(spark, sf):
    """Two issues of classified documents."""
    a = documents_as_articles(table(spark, sf, "documents"), "lang")
    en = F.col("lang") == "en"
    day = F.lpad((F.col("entry_ord") % 28 + 1).cast("string"), 2, "0")
    a = a.withColumns(
        {
            "author": F.when(~en, F.concat(F.lit("Author "), "lang")),
            "published": F.when(en, F.concat(F.lit("2024-01-"), day, F.lit("T08:00:00Z"))).when(F.col("lang") == "de", "some day"),
            "image_url": F.when(F.col("lang") == "fr", F.concat("url", F.lit(".png"))),
        }
    )
    return process_articles(a, F.when(en, ISSUES["en"]).otherwise(ISSUES["other"]))


#: What lists of articles read, and what rendered articles read besides.
LISTED = ("issue", "category", "subcategory", "feed_ord", "entry_ord", "title", "url")
RENDERED = (*LISTED, "author", "source", "summary", "published", "image_url", "full_text", "content", "domain", "features", "reading_time")


def issue_articles(spark, sf, *columns):
    """The same, written once to the work folder for queries that read it several times; with ``columns`` only these.

    The content of a document is its full text, which is stored once.
    """
    made = processed_documents(spark, sf)
    made = made.select(*columns) if columns else made
    stored = written(made.drop("content"), "issue-articles")
    return stored.withColumn("content", F.col("full_text")).select(made.columns) if "content" in made.columns else stored


_ISS = f"""iss AS (SELECT CAST(1 AS BIGINT) AS feed_ord, doc_id AS entry_ord, split_part(text, chr(10), 1) AS title,
      'https://' || source || '.example.com/' || doc_id AS url, source, lang, '' AS summary, text AS full_text, text AS content,
      CASE WHEN lang = 'en' THEN '{ISSUES['en']}' ELSE '{ISSUES['other']}' END AS issue,
      CASE WHEN lang <> 'en' THEN 'Author ' || lang END AS author,
      CASE WHEN lang = 'en' THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T08:00:00Z' WHEN lang = 'de' THEN 'some day' END AS published,
      CASE WHEN lang = 'en' THEN 'January ' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ', 2024' WHEN lang = 'de' THEN 'some day' END AS shown,
      CASE WHEN lang = 'fr' THEN 'https://' || source || '.example.com/' || doc_id || '.png' END AS image_url FROM documents)"""
FIN = f"""{_ISS}, {q.classified('iss')}, fin AS (SELECT *, coalesce(subcategory, '') AS sub,
      CAST(greatest(1, {q.word_count('full_text')} // 200) AS BIGINT) AS reading_time,
      {q.paywalled('full_text', 'url')} AS is_paywalled, source || '.example.com' AS domain,
      '[' || title || '](' || url || ')' AS tlink FROM cls)"""
DATES = f"CASE issue WHEN '{ISSUES['en']}' THEN 'February 05, 2024' ELSE 'February 12, 2024' END"


def extracts(limit: int) -> str:
    """CTE ``ext``: fin with its word-limited extract."""
    return f"""knd AS (SELECT *, {_KIND.replace('(t,', '(full_text,').replace('strip', 'strip')} AS kind FROM (SELECT *, full_text AS t FROM fin)),
    jnd AS (SELECT *, CASE WHEN kind = 'spaced_chars' THEN {_SPACED} WHEN kind IS NOT NULL THEN array_to_string({_LINES}, '')
                      ELSE {q.scrub('t')} END AS j FROM knd),
    cln AS (SELECT *, {q.strip_tags('j')} AS c FROM jnd),
    ext AS (SELECT *, CASE WHEN c = '' THEN '' ELSE '<p>' || {q.truncate_words('c', limit)} || '</p>' ||
              CASE WHEN kind IS NULL THEN chr(10) || chr(10) ELSE '' END END AS extracted FROM cln)"""


def row(kind: str, part: int, line: str, origin: str, **order: str) -> str:
    names = {"section_ord": "0", "section": "''", "sub_ord": "0", "subsection": "''", "feed_ord": "-1", "entry_ord": "-1", "line_ord": "0"}
    names.update(order)
    cols = ", ".join(f"{v} AS {k}" if k in ("section", "subsection") else f"CAST({v} AS BIGINT) AS {k}" for k, v in names.items())
    return f"SELECT issue, '{kind}' AS kind, CAST({part} AS BIGINT) AS part, {cols}, {line} AS line FROM {origin}"


ART = {"feed_ord": "feed_ord", "entry_ord": "entry_ord"}
ISSUE_ROWS = "(SELECT DISTINCT issue FROM fin)"
CATS = "(SELECT issue, category, count(*) AS n FROM fin GROUP BY issue, category)"
T = digest.TITLE
NL = "chr(10)"


@query("category_counts", f"WITH {FIN} SELECT issue, category, n AS articles FROM {CATS}")
def category_counts_query(spark, sf):
    return category_counts(processed_documents(spark, sf), "issue")


@query("subcategory_groups", f"""
    WITH {FIN} SELECT issue, category, CASE WHEN sub = '' THEN 'Other' ELSE sub END AS subcategory, sub = '' AS is_other,
      count(*) AS articles, min(feed_ord) AS first_feed, min(entry_ord) AS first_entry FROM fin GROUP BY issue, category, sub""")
def subcategory_groups_query(spark, sf):
    return subcategory_groups(processed_documents(spark, sf), "issue")


@query("paywalled_count", f"""
    WITH {FIN}, c AS (SELECT issue, count(*) FILTER (is_paywalled) AS paywalled FROM fin GROUP BY issue)
    SELECT issue, paywalled, CASE WHEN paywalled > 0 THEN '*Note: ' || paywalled || ' article' || CASE WHEN paywalled > 1 THEN 's' ELSE '' END ||
      ' may be behind a paywall.*' END AS note FROM c""")
def paywalled_count_query(spark, sf):
    return paywalled_count(processed_documents(spark, sf), "issue")


@query("category_lists", f"""
    WITH {FIN}, b AS (SELECT category, feed_ord, entry_ord, entry_ord // 100 AS part, {q.basic_block('full_text', "coalesce(author, '')", "coalesce(shown, '')")} AS block FROM fin)
    SELECT category, feed_ord, part, md5(string_agg(block, chr(10) ORDER BY entry_ord)) AS digest FROM b GROUP BY ALL""")
def category_lists_query(spark, sf):
    lists = digest.category_lists(processed_documents(spark, sf), F.col("processed_content"), rows_per_part=100)
    return lists.select("category", "feed_ord", "part", F.md5(F.array_join("blocks", "\n")).alias("digest"))


@query("assemble_parts", """
    SELECT conv_id, turn // 4 AS part, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2""")
def assemble_parts_query(spark, sf):
    return digest.assemble_parts(table(spark, sf, "conversations"), "conv_id", "turn", "text", rows_per_part=4)


_NUM = f"""nums AS (SELECT *, dense_rank() OVER (PARTITION BY issue ORDER BY category) AS i FROM fin),
    subn AS (SELECT issue, category, sub, row_number() OVER (PARTITION BY issue, category ORDER BY sub = '', sub) AS j,
                    count(*) FILTER (sub <> '') OVER (PARTITION BY issue, category) AS n_subs
             FROM (SELECT DISTINCT issue, category, sub FROM fin)),
    num AS (SELECT nums.*, j, n_subs, row_number() OVER (PARTITION BY issue, category, sub ORDER BY feed_ord, entry_ord) AS k
            FROM nums JOIN subn USING (issue, category, sub)),
    numbered AS (SELECT *, CASE WHEN n_subs > 0 THEN i || '.' || j || '.' || k ELSE i || '.' || k END AS number FROM num)"""


@query("number_contents", f"WITH {FIN}, {_NUM} SELECT issue, category, sub AS subcategory, entry_ord, number FROM numbered")
def number_contents_query(spark, sf):
    return digest.number_contents(issue_articles(spark, sf, *LISTED)).select("issue", "category", "subcategory", "entry_ord", "number")


_BLOCK = q.basic_block("full_text", "coalesce(author, '')", "coalesce(shown, '')")


def _newsletter_sql() -> str:
    k = "newsletter"
    return " UNION ALL ".join([
        row(k, 0, f"'# {T}' || {NL} || {NL} || 'Generated on ' || {DATES} || {NL} || {NL} || '## In This Issue' || {NL}", ISSUE_ROWS),
        row(k, 1, "'- ' || category || ': ' || n || ' articles'", CATS, section="category"),
        row(k, 2, f"{NL} || '---' || {NL}", ISSUE_ROWS),
        row(k, 3, f"'## ' || category || {NL}", CATS, section="category"),
        row(k, 3, f"{_BLOCK} || {NL} || '---' || {NL}", "fin", section="category", **ART),
    ])


@query("newsletter", f"WITH {FIN} {_newsletter_sql()}")
def newsletter_query(spark, sf):
    return digest.newsletter(issue_articles(spark, sf))


def _reading_list_sql() -> str:
    k = "reading_list"
    return " UNION ALL ".join([
        row(k, 0, f"'# {T} - Reading List' || {NL} || {NL} || 'Generated on ' || {DATES} || {NL}", ISSUE_ROWS),
        row(k, 1, f"'## ' || category || {NL}", CATS, section="category"),
        row(k, 1, "'- ' || tlink", "fin", section="category", sub_ord="1", **ART),
        row(k, 1, "''", CATS, section="category", sub_ord="2"),
    ])


@query("reading_list", f"WITH {FIN} {_reading_list_sql()}")
def reading_list_query(spark, sf):
    return digest.reading_list(issue_articles(spark, sf, *LISTED))


def _marked_sql() -> str:
    k = "reading_list_marked"
    notes = "(SELECT issue, count(*) FILTER (is_paywalled) AS p FROM fin GROUP BY issue)"
    many = f"(SELECT * FROM {CATS} WHERE issue IN (SELECT issue FROM {CATS} GROUP BY issue HAVING count(*) > 1))"
    note = f"CASE WHEN p > 0 THEN {NL} || '*Note: ' || p || ' article' || CASE WHEN p > 1 THEN 's' ELSE '' END || ' may be behind a paywall.*' || {NL} ELSE '' END"
    return " UNION ALL ".join([
        row(k, 0, f"'# {T} - Reading List' || {NL} || {NL} || 'Generated on ' || {DATES} || {NL} || {note}", notes),
        row(k, 1, "'## ' || category", many, section="category"),
        row(k, 1, "'- ' || tlink || CASE WHEN is_paywalled THEN ' ' || chr(128274) ELSE '' END", "fin", section="category", sub_ord="1", **ART),
        row(k, 1, "''", many, section="category", sub_ord="2"),
    ])


@query("marked_reading_list", f"WITH {FIN} {_marked_sql()}")
def marked_reading_list_query(spark, sf):
    return digest.marked_reading_list(issue_articles(spark, sf, *LISTED, "is_paywalled"))


_TABS = ("'<div class=\"metadata\">' || chr(10) || concat_ws(chr(9), '**Source:** ' || source, '**Author:** ' || author, "
         "'**Published:** ' || published, '**Reading Time:** ' || reading_time || ' min', '**Domain:** ' || domain) || chr(10) || '</div>' || chr(10) || chr(10)")
_META_LINES = ("'<div class=\"metadata\">' || chr(10) || concat_ws(chr(10), '**Source:** ' || source, '**Date:** ' || shown, "
               "'**Category:** ' || category || CASE WHEN sub <> '' THEN ' / ' || sub ELSE '' END, '**Reading time:** ' || reading_time || ' min') || chr(10) || '</div>'")
_META_LINE = ("concat_ws(' ', '**Author:** ' || author, '**Source:** ' || source, '**Published:** ' || shown, '**Classification:** ' || category, "
              "'**Subcategory:** ' || nullif(sub, ''), '**Domain:** ' || domain)")
_IMAGE = "CASE WHEN image_url IS NOT NULL THEN '![' || title || '](' || image_url || ')' || chr(10) || chr(10) ELSE '' END"
_MORE = "'[Read more](' || url || ')'"


@query("metadata_lines", f"""
    WITH {FIN} SELECT entry_ord, {_META_LINE} AS one_line, {_TABS} AS tabs, {_META_LINES} AS lines FROM fin""")
def metadata_lines_query(spark, sf):
    return processed_documents(spark, sf).select(
        "entry_ord", metadata_line().alias("one_line"), metadata_tabs().alias("tabs"), metadata_lines().alias("lines"))


def _snippets_sql() -> str:
    k = "snippets"
    block = f"'### ' || tlink || {NL} || {NL} || {_TABS} || extracted || {NL} || {NL} || {_MORE} || {NL} || {NL} || '---' || {NL}"
    return " UNION ALL ".join([
        row(k, 0, f"'# {T} - Extended Reading List' || {NL} || {NL} || 'Generated on ' || {DATES} || {NL}", ISSUE_ROWS),
        row(k, 1, f"'## ' || category || {NL}", CATS, section="category"),
        row(k, 1, block, "ext", section="category", **ART),
    ])


@query("snippets", f"WITH {FIN}, {extracts(500)} {_snippets_sql()}")
def snippets_query(spark, sf):
    a = issue_articles(spark, sf, *RENDERED)
    return digest.snippets(a.withColumn("processed_content", F.lit(None).cast("string")))


def _sections_sql() -> str:
    k = "newsletter_sections"
    block = (f"'### ' || title || {NL} || {NL} || {_META_LINES} || {NL} || {NL} || {_IMAGE} || extracted || {NL} || {NL} || {_MORE} || "
             f"{NL} || {NL} || '---' || {NL} || {NL} || '---' || {NL}")
    return " UNION ALL ".join([
        row(k, 0, f"'# {T}' || {NL} || 'Generated on ' || {DATES} || {NL} || {NL} || '## In This Issue'", ISSUE_ROWS),
        row(k, 1, "'- ' || category || ': ' || n || ' articles'", CATS, section="category"),
        row(k, 2, f"'---' || {NL}", ISSUE_ROWS),
        row(k, 3, "'## ' || category", CATS, section="category"),
        row(k, 3, "'### ' || CASE WHEN sub = '' THEN 'Other' ELSE sub END", "(SELECT * FROM seen WHERE n_subs > 0)", section="category", sub_ord="seen_rank"),
        row(k, 3, block, "(SELECT * FROM ext JOIN seen USING (issue, category, sub))", section="category", sub_ord="seen_rank", **ART),
    ])


_SEEN = """seen AS (SELECT issue, category, sub, row_number() OVER (PARTITION BY issue, category ORDER BY sub = '', f, e) AS seen_rank,
      count(*) FILTER (sub <> '') OVER (PARTITION BY issue, category) AS n_subs
      FROM (SELECT issue, category, sub, min(feed_ord) AS f, min(entry_ord) AS e FROM fin GROUP BY issue, category, sub))"""


@query("sectioned_newsletter", f"WITH {FIN}, {_SEEN}, {extracts(1500)} {_sections_sql()}")
def sectioned_newsletter_query(spark, sf):
    a = issue_articles(spark, sf, *RENDERED).withColumn("processed_content", F.lit(None).cast("string"))
    return digest.sectioned_newsletter(a)


def _contents_sql() -> str:
    k = "contents"
    slug = "lower(replace({0}, ' ', '-'))"
    cats = "(SELECT DISTINCT issue, category, i FROM num)"
    subs = "(SELECT DISTINCT issue, category, sub, i, j, n_subs FROM num)"
    named = f"(SELECT * FROM {subs} WHERE n_subs > 0)"
    return " UNION ALL ".join([
        row(k, 0, f"'# {T} - Contents' || {NL} || {NL} || 'Generated on ' || {DATES} || {NL} || {NL} || '## Table of Contents'", ISSUE_ROWS),
        row(k, 1, f"i || '. [' || category || '](#' || {slug.format('category')} || ')'", cats, section_ord="i"),
        row(k, 1, f"'   ' || i || '.' || j || '. [' || sub || '](#' || {slug.format('sub')} || ')'", f"(SELECT * FROM {named} WHERE sub <> '')", section_ord="i", sub_ord="j"),
        row(k, 2, "''", ISSUE_ROWS),
        row(k, 3, "'## ' || i || '. ' || category", cats, section_ord="i"),
        row(k, 3, "'### ' || i || '.' || j || '. ' || CASE WHEN sub = '' THEN 'Other' ELSE sub END", named, section_ord="i", sub_ord="j"),
        row(k, 3, "number || '. ' || tlink", "numbered", section_ord="i", sub_ord="j", line_ord="1", **ART),
        row(k, 3, "''", subs, section_ord="i", sub_ord="j", feed_ord=str(2**62)),
    ])


@query("contents", f"WITH {FIN}, {_NUM} {_contents_sql()}")
def contents_query(spark, sf):
    return digest.contents(issue_articles(spark, sf, *LISTED))


@query("article_blocks", f"""
    WITH {FIN}, {extracts(1500)}
    SELECT entry_ord, md5('### ' || tlink || {NL} || {NL} || {_META_LINE} || {NL} || {NL} || {_IMAGE} ||
        CASE WHEN extracted = '' THEN '*No content available*' ELSE extracted END || {NL} || {NL} || {_MORE} || {NL}) AS full_block,
      md5('## ' || tlink || {NL} || '<div class="metadata">' || {NL} || {_META_LINE} || {NL} || '</div>' || {NL} || {NL} || extracted || {NL} || {NL} ||
        {_MORE} || {NL} || {NL} || '---' || {NL} || {NL}) AS original, md5({_BLOCK}) AS basic FROM ext""")
def article_blocks(spark, sf):
    """Basic, full and original blocks; the extract has the 1500 words of a full block in both."""
    a = processed_documents(spark, sf).withColumn("processed_content", F.lit(None).cast("string"))
    e = extract_paragraphs(a, "full_text", 1500, "extract")
    return e.select(
        "entry_ord", F.md5(block_full(F.col("extract"), F.col("extract"))).alias("full_block"),
        F.md5(block_original(F.col("extract"))).alias("original"), F.md5(block_basic(local_body())).alias("basic"),
    )


_HTML_ITEM = ("'<li><a href=\"' || url || '\">' || regexp_replace(title, '\\*\\*([^*<]+)\\*\\*', '<strong>\\1</strong>', 'g') || '</a></li>'")


def _html_reading_list_sql() -> str:
    k = "reading_list"
    return " UNION ALL ".join([
        row(k, 0, f"'<h1>{T} - Reading List</h1>' || {NL} || {NL} || '<p>Generated on ' || {DATES} || '</p>' || {NL}", ISSUE_ROWS),
        row(k, 1, f"'<h2>' || category || '</h2>' || {NL}", CATS, section="category"),
        row(k, 1, _HTML_ITEM, "fin", section="category", sub_ord="1", **ART),
        row(k, 1, "''", CATS, section="category", sub_ord="2"),
    ])


@query("html_digest", f"""
    WITH {FIN} {_html_reading_list_sql()}
    UNION ALL {row('reading_list', -1, f"'<!DOCTYPE html>' || {NL} || '<html>' || {NL} || '<body>'", ISSUE_ROWS)}
    UNION ALL {row('reading_list', 1000, "'</body>' || chr(10) || '</html>'", ISSUE_ROWS)}""")
def html_digest(spark, sf):
    return html_lines(digest.reading_list(issue_articles(spark, sf, *LISTED)))


@query("conversion_status", f"""
    WITH {FIN}, lines AS ({_reading_list_sql()})
    SELECT issue, kind, count(*) AS rows, true AS converted FROM lines GROUP BY issue, kind""")
def conversion_status_query(spark, sf):
    return conversion_status(digest.reading_list(issue_articles(spark, sf, *LISTED)))


@query("digest_files", f"""
    WITH {FIN}, lines AS ({_reading_list_sql()})
    SELECT issue, kind, line AS text_line, count(*) AS n
    FROM (SELECT issue, kind, unnest(string_split(line, chr(10))) AS line FROM lines) GROUP BY ALL""")
def digest_files(spark, sf):
    """A reading list written as text and read back."""
    path = work_dir(spark, "digest-files")
    write_digest_md(digest.reading_list(issue_articles(spark, sf, *LISTED)), path)
    stored = spark.read.schema("value string, issue string, kind string").option("lineSep", "\n").text(path)
    return stored.groupBy("issue", "kind", F.col("value").alias("text_line")).agg(F.count("*").alias("n"))
