"""Queries over the text, URL, time and markup functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions import markup
from inkfold.functions import text as tx
from inkfold.functions.features import (
    has_code, on_paywall_domain, paywall_flag, quote_count, technical_terms,
)
from inkfold.functions.html import is_html
from inkfold.operators.budget import budget_paragraphs, word_budget
from inkfold.operators.extract import extract_paragraphs
from inkfold.operators.keywords import top_keywords, word_frequency
from inkfold.plans import sql_parts as q
from inkfold.plans.catalog import query
from inkfold.session import spread
from inkfold.sources.tables import documents_as_articles, table


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query("count_occurrences", f"""
    SELECT doc_id, {q.occurrences('lower(text)', 'ai')} AS n_ai, {q.occurrences('lower(text)', 'go')} AS n_go,
           {q.occurrences('text', 'the ')} AS n_the FROM documents""")
def count_occurrences(spark, sf):
    return docs(spark, sf).select(
        "doc_id", tx.count_occurrences(F.lower("text"), "ai").alias("n_ai"),
        tx.count_occurrences(F.lower("text"), "go").alias("n_go"),
        tx.count_occurrences("text", "the ").alias("n_the"),
    )


@query("weighted_text", f"""
    WITH {q.ARTICLES} SELECT entry_ord, md5(lower(title || ' ' || title || ' ' || full_text)) AS digest FROM art""")
def weighted_text(spark, sf):
    a = documents_as_articles(table(spark, sf, "documents"))
    return a.select("entry_ord", F.md5(tx.weighted_text("title", "full_text")).alias("digest"))


@query("word_count_reading_time", f"""
    SELECT doc_id, {q.word_count('text')} AS words,
           CAST(greatest(1, {q.word_count('text')} // 200) AS BIGINT) AS reading_time FROM documents""")
def word_count_reading_time(spark, sf):
    d = docs(spark, sf).select("doc_id", tx.word_count("text").alias("words"))
    return d.withColumn("reading_time", tx.reading_time("words"))


@query("token_estimate", f"""
    SELECT doc_id, CAST({q.word_count('text')} + length(text) // 4 AS BIGINT) AS tokens FROM documents""")
def token_estimate(spark, sf):
    return docs(spark, sf).select("doc_id", tx.token_estimate("text").alias("tokens"))


@query("truncate_chars", f"SELECT doc_id, {q.truncate_chars('text', 500)} AS lead FROM documents")
def truncate_chars(spark, sf):
    return docs(spark, sf).select("doc_id", tx.truncate_chars("text", 500).alias("lead"))


@query("truncate_words", f"SELECT doc_id, md5({q.truncate_words('text', 100)}) AS digest FROM documents")
def truncate_words(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.truncate_words("text", 100)).alias("digest"))


@query("normalize_ws", f"SELECT doc_id, md5({q.normalize('text')}) AS digest FROM documents")
def normalize_ws(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.normalize_ws("text")).alias("digest"))


@query("sentences", f"""
    SELECT doc_id, CAST(len({q.sentences('text')}) AS BIGINT) AS n_sentences,
           md5(array_to_string({q.sentences('text')}, '|')) AS digest FROM documents""")
def sentences(spark, sf):
    d = docs(spark, sf).select("doc_id", tx.sentences("text").alias("s"))
    return d.select(
        "doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest")
    )


@query("lead_summary", f"""
    WITH t AS (SELECT doc_id, {q.normalize('text')} AS n FROM documents)
    SELECT doc_id, {q.lead_summary('n')} AS summary FROM t""")
def lead_summary(spark, sf):
    d = docs(spark, sf).select("doc_id", tx.normalize_ws("text").alias("n"))
    return d.select("doc_id", tx.lead_summary("n").alias("summary"))


@query("extract_words", f"""
    SELECT doc_id, CAST(len({q.plain_words('text')}) AS BIGINT) AS n_words,
           md5(array_to_string({q.plain_words('text')}, ' ')) AS digest FROM documents""")
def extract_words(spark, sf):
    d = docs(spark, sf).select("doc_id", tx.extract_words("text").alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("word_frequency", f"""
    SELECT lang, word, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT lang, unnest({q.plain_words('text')}) AS word FROM documents) GROUP BY lang, word""")
def word_frequency_by_lang(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    per_text = word_frequency(d.withColumn("key", F.struct("doc_id", "lang")), "key", "text")
    return per_text.groupBy(F.col("key.lang").alias("lang"), "word").agg(F.sum("n").alias("n"))


@query("top_keywords", f"""
    WITH w AS (SELECT doc_id, unnest({q.plain_words('text')}) AS word,
                      generate_subscripts({q.plain_words('text')}, 1) AS pos FROM documents),
    c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS p FROM w GROUP BY doc_id, word),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rk FROM c),
    k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY rk) AS keywords FROM r WHERE rk <= 5 GROUP BY doc_id)
    SELECT d.doc_id, coalesce(k.keywords, '') AS keywords FROM documents d LEFT JOIN k USING (doc_id)""")
def top_keywords_query(spark, sf):
    k = top_keywords(docs(spark, sf), "text", 5)
    return k.select("doc_id", F.array_join("keywords", " ").alias("keywords"))


@query("slug", f"""
    WITH {q.ARTICLES} SELECT entry_ord, replace(lower(title), ' ', '-') AS slug FROM art""")
def slug(spark, sf):
    a = documents_as_articles(table(spark, sf, "documents"))
    return a.select("entry_ord", tx.slug("title").alias("slug"))


_DAMAGED = """
    damaged AS (
      SELECT conv_id, turn, 'lines' AS damage, regexp_replace(text, '(.)', '\\1' || chr(10), 'gs') AS t FROM conversations
      UNION ALL SELECT conv_id, turn, 'spaces', regexp_replace(text, '(.)', '\\1 ', 'gs') FROM conversations
      UNION ALL SELECT conv_id, turn, 'some', text || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' FROM conversations
      UNION ALL SELECT conv_id, turn, 'none', text FROM conversations)"""
_LINES = f"list_transform(string_split(t, chr(10)), lambda x: {q.strip('x')})"
_FILLED = f"list_filter({_LINES}, lambda x: x <> '')"
_KIND = f"""CASE
      WHEN contains(t, chr(10)) AND length({q.strip('t')}) > 20 AND len({_FILLED}) > 5
           AND len(list_filter({_FILLED}, lambda x: length(x) <= 1)) / len({_FILLED}) > 0.6 THEN 'single_char_lines'
      WHEN regexp_matches(t, '(^|{q.NW}){q.W} {q.W} {q.W} {q.W}($|{q.NW})') THEN 'spaced_chars'
      WHEN regexp_matches(t, '\\n{q.WS}*{q.W}{q.WS}*\\n{q.WS}*{q.W}{q.WS}*\\n{q.WS}*{q.W}') THEN 'split_lines' END"""
_SPACED = (
    f"regexp_replace(regexp_replace(regexp_replace(t, '({q.W}) ({q.W}) ({q.W})', '\\1\\2\\3', 'g'), "
    f"'({q.W}) ({q.W})', '\\1\\2', 'g'), '({q.W}) ({q.W})', '\\1\\2', 'g')"
)


@query("repair_split_text", f"""
    WITH {_DAMAGED}, kinds AS (SELECT *, {_KIND} AS kind FROM damaged),
    joined AS (SELECT *, CASE WHEN kind = 'spaced_chars' THEN {_SPACED}
                              WHEN kind IS NOT NULL THEN array_to_string({_LINES}, '') END AS j FROM kinds),
    cleaned AS (SELECT conv_id, turn, damage, kind, {q.strip_tags('j')} AS c FROM joined)
    SELECT conv_id, turn, damage, kind AS repair_kind,
           CASE WHEN c = '' THEN '' WHEN c IS NOT NULL THEN '<p>' || {q.truncate_words('c', 50)} || '</p>' END AS repaired
    FROM cleaned""")
def repair_split_text(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    kinds = F.array(
        F.struct(F.lit("lines").alias("damage"), F.regexp_replace("text", "(?s)(.)", "$1\n").alias("t")),
        F.struct(F.lit("spaces").alias("damage"), F.regexp_replace("text", "(?s)(.)", "$1 ").alias("t")),
        F.struct(F.lit("some").alias("damage"), F.concat("text", F.lit("\na\nb\nc")).alias("t")),
        F.struct(F.lit("none").alias("damage"), F.col("text").alias("t")),
    )
    d = c.select("conv_id", "turn", F.inline(kinds)).withColumn("repair_kind", tx.repair_kind("t"))
    return d.withColumn("repaired", tx.repair_split_text("t", "repair_kind", 50)).drop("t")


@query("markup_tests", """
    SELECT page_id, regexp_matches(html, '<[a-zA-Z][^>]{0,1}>[^<]{0,1}<') AS malformed,
           regexp_matches(html, '<[a-zA-Z][^>]*>(.*?)</[a-zA-Z][^>]*>', 's') AS is_html FROM pages""")
def markup_tests(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.is_malformed_html("html").alias("malformed"), is_html("html").alias("is_html"))


@query("published_dates", """
    WITH p AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
                 CASE WHEN event_type = 'error' THEN '+00:00' ELSE 'Z' END AS published FROM events)
    SELECT event_id, try_strptime(published, '%Y-%m-%dT%H:%M:%SZ') AS published_ts,
           coalesce(strftime(try_strptime(published, '%Y-%m-%dT%H:%M:%SZ'), '%B %d, %Y'), published) AS shown FROM p""")
def published_dates(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("event_type") == "error", "+00:00").otherwise("Z")
    e = table(spark, sf, "events").select("event_id", F.concat(stamp, zone).alias("published"))
    # The oracle's timestamps have no zone.
    return e.select(
        "event_id", tx.parse_published("published").cast("timestamp_ntz").alias("published_ts"),
        tx.format_published("published").alias("shown"),
    )


@query("issue_dates", """
    SELECT CAST(ts AS DATE)::VARCHAR AS issue, strftime(CAST(ts AS DATE), '%B %d, %Y') AS shown, count(*) AS events
    FROM events GROUP BY 1, 2""")
def issue_dates(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("issue")).agg(F.count("*").alias("events"))
    return days.withColumn("shown", tx.format_issue_date("issue"))


@query("domains", """
    SELECT page_id, regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1) AS domain,
           regexp_extract(url, '://([^/]*)', 1) AS after_scheme FROM pages""")
def domains(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.domain("url").alias("domain"), tx.domain_after_scheme("url").alias("after_scheme")
    )


@query("code_quotes_terms", f"""
    SELECT doc_id, {q.has_code('text')} AS has_code, CAST({q.occurrences('text', '"')} AS BIGINT) AS quote_count,
           {q.technical_terms('text')} AS technical_terms FROM documents""")
def code_quotes_terms(spark, sf):
    return docs(spark, sf).select(
        "doc_id", has_code("text").alias("has_code"), quote_count("text").alias("quote_count"),
        technical_terms("text").alias("technical_terms"),
    )


_SITES = "list_value('https://www.ft.com/', 'https://u@news.medium.com:443/', 'https://www.microsoft.com/', 'https://src.example.com/')"


@query("paywall_flag", f"""
    WITH t AS (SELECT doc_id, text, unnest({_SITES}) || doc_id AS url FROM documents)
    SELECT doc_id, url, {q.on_paywall_domain('url')} AS known_site, {q.paywalled('text', 'url')} AS paywalled,
           ({q.any_of('lower(text)', q.PAYWALL_TERMS)} OR ({q.any_of("regexp_extract(url, '://([^/]*)', 1)", q.PAYWALL_DOMAINS)}
             AND length(text) < 1000)) AS paywalled_substring FROM t""")
def paywall(spark, sf):
    sites = F.array(*[F.lit(s) for s in (
        "https://www.ft.com/", "https://u@news.medium.com:443/", "https://www.microsoft.com/", "https://src.example.com/")])
    d = docs(spark, sf).select("doc_id", "text", F.explode(sites).alias("site"))
    d = d.withColumn("url", F.concat("site", F.col("doc_id").cast("string")))
    return d.select(
        "doc_id", "url", on_paywall_domain("url").alias("known_site"), paywall_flag("text", "url").alias("paywalled"),
        paywall_flag("text", "url", mode="substring").alias("paywalled_substring"),
    )


@query("word_budget", f"""
    WITH p AS (SELECT conv_id, turn, {q.strip('text')} AS para FROM conversations),
    w AS (SELECT *, {q.word_count('para')} AS n FROM p WHERE para <> ''),
    r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM w)
    SELECT conv_id, turn, CASE WHEN run <= 120 THEN para ELSE
           array_to_string(({q.word_list('para')})[1:CAST(120 - (run - n) AS BIGINT)], ' ') || '...' END AS text
    FROM r WHERE run - n < 120""")
def word_budget_query(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return word_budget(c, "conv_id", "turn", "text", 120)


@query("word_budget_uncut_kinds", f"""
    WITH p AS (SELECT conv_id, turn, role, {q.strip('text')} AS para FROM conversations),
    w AS (SELECT *, {q.word_count('para')} AS n FROM p WHERE para <> ''),
    r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM w)
    SELECT conv_id, turn, role, CASE WHEN run <= 80 THEN para ELSE
           array_to_string(({q.word_list('para')})[1:CAST(80 - (run - n) AS BIGINT)], ' ') || '...' END AS text
    FROM r WHERE run - n < 80 AND (run <= 80 OR role = 'assistant')""")
def word_budget_uncut_kinds(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return word_budget(c, "conv_id", "turn", "text", 80, cut=F.col("role") == "assistant")


@query("paragraph_budget", f"""
    WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    w AS (SELECT doc_id, i, {q.strip('raw')} AS para, {q.word_count('raw')} AS n FROM p),
    r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM w WHERE n > 0),
    k AS (SELECT doc_id, i, CASE WHEN run <= 100 THEN para ELSE
            array_to_string(({q.word_list('para')})[1:CAST(100 - (run - n) AS BIGINT)], ' ') || '...' END AS t
          FROM r WHERE run - n < 100),
    a AS (SELECT doc_id, string_agg(t, '|' ORDER BY i) AS kept FROM k GROUP BY doc_id)
    SELECT d.doc_id, coalesce(a.kept, '') AS kept FROM documents d LEFT JOIN a USING (doc_id)""")
def paragraph_budget(spark, sf):
    kept = budget_paragraphs(F.split("text", "\n"), 100)
    return docs(spark, sf).select("doc_id", F.array_join(kept, "|").alias("kept"))


@query("extract_paragraphs", f"""
    WITH d AS (SELECT doc_id, text AS t FROM documents), kinds AS (SELECT *, {_KIND} AS kind FROM d),
    joined AS (SELECT doc_id, kind, CASE WHEN kind = 'spaced_chars' THEN {_SPACED}
                 WHEN kind IS NOT NULL THEN array_to_string({_LINES}, '') ELSE {q.scrub('t')} END AS j FROM kinds),
    cleaned AS (SELECT doc_id, kind, {q.strip_tags('j')} AS c FROM joined)
    SELECT doc_id, coalesce(kind, CASE WHEN c = '' THEN 'empty' ELSE 'plain' END) AS kind,
           CASE WHEN c = '' THEN '' ELSE '<p>' || {q.truncate_words('c', 500)} || '</p>' ||
             CASE WHEN kind IS NULL THEN chr(10) || chr(10) ELSE '' END END AS extracted FROM cleaned""")
def extract_paragraphs_query(spark, sf):
    return extract_paragraphs(docs(spark, sf), "text", 500, kind="kind").drop("text")


_MD = ("'# ' || role || chr(10) || '## turn ' || turn || chr(10) || '- ![pic ' || turn || '](https://img.example.com/' || conv_id || "
       "') and [link](https://example.com/' || conv_id || ') note [' || turn || '](#fn1-2) by ' || role || ' (@user' || conv_id || "
       "')[Jan ' || turn || '] **' || role || '** *em* ' || chr(10) || text")


def _markdown(spark, sf):
    c = table(spark, sf, "conversations")
    conv, turn, role = F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role")
    md = F.concat(
        F.lit("# "), role, F.lit("\n## turn "), turn, F.lit("\n- ![pic "), turn, F.lit("](https://img.example.com/"), conv,
        F.lit(") and [link](https://example.com/"), conv, F.lit(") note ["), turn, F.lit("](#fn1-2) by "), role,
        F.lit(" (@user"), conv, F.lit(")[Jan "), turn, F.lit("] **"), role, F.lit("** *em* \n"), F.col("text"),
    )
    return c.select("conv_id", "turn", md.alias("md"))


@query("markup_rewrites", f"""
    WITH m AS (SELECT conv_id, turn, {_MD} AS md FROM conversations)
    SELECT conv_id, turn,
      regexp_replace(md, '([\\p{{L}}\\p{{N}}_]+)\\s+\\(@([\\p{{L}}\\p{{N}}_]+)\\)\\[([^\\]]+)\\]',
        '<strong>\\1</strong> <span class="twitter-handle">@\\2</span> <span class="tweet-date">\\3</span>', 'g') AS handles,
      regexp_replace(md, '!\\[(.*?)\\]\\((.*?)\\)', '<img src="\\2" alt="\\1">', 'g') AS images,
      regexp_replace(md, '\\[(.*?)\\]\\((.*?)\\)', '<a href="\\2">\\1</a>', 'g') AS links,
      regexp_replace(md, '\\[(\\d+)\\](?:\\(#fn\\d+-\\d+\\))?', '<sup><a href="#footnote-\\1">\\1</a></sup>', 'g') AS footnotes,
      regexp_replace(md, '\\*\\*([^*]+)\\*\\*', '<strong>\\1</strong>', 'g') AS bold
    FROM m""")
def markup_rewrites(spark, sf):
    return _markdown(spark, sf).select(
        "conv_id", "turn", markup.handles("md").alias("handles"), markup.images("md").alias("images"),
        markup.links("md").alias("links"), markup.footnotes("md").alias("footnotes"), markup.bold("md").alias("bold"),
    )


@query("simple_markdown", f"""
    WITH m AS (SELECT conv_id, turn, {_MD} AS md FROM conversations),
    h AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(md, '### (.*?)\\n', '<h3>\\1</h3>' || chr(10), 'g'),
            '## (.*?)\\n', '<h2>\\1</h2>' || chr(10), 'g'), '# (.*?)\\n', '<h1>\\1</h1>' || chr(10), 'g') AS t FROM m)
    SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
       '\\*\\*(.*?)\\*\\*', '<strong>\\1</strong>', 'g'), '\\*(.*?)\\*', '<em>\\1</em>', 'g'),
       '\\[(.*?)\\]\\((.*?)\\)', '<a href="\\2">\\1</a>', 'g'), '(?m)^- (.*?)$', '<li>\\1</li>', 'g') AS html FROM h""")
def simple_markdown(spark, sf):
    return _markdown(spark, sf).select("conv_id", "turn", markup.simple_markdown("md").alias("html"))


@query("metadata_divs", """
    SELECT doc_id, '<hr/>' || chr(10) || '<div class="metadata"><strong>Source:</strong> ' || source ||
      '&nbsp;&nbsp;•&nbsp;&nbsp;<strong>Lang:</strong> ' || lang || ': ' || n_chars || '</div>' || chr(10) || '<hr/>' AS html
    FROM documents""")
def metadata_divs(spark, sf):
    d = table(spark, sf, "documents")
    div = F.concat(
        F.lit('<div class="metadata">\n**Source:** '), "source", F.lit("\tno label\t**Lang:** "), "lang", F.lit(": "),
        F.col("n_chars").cast("string"), F.lit("\n</div>"),
    )
    return d.select("doc_id", markup.metadata_divs(div).alias("html"))
