"""Pieces of the checking SQL, written apart from the Spark expressions they check."""

from __future__ import annotations

from inkfold.rules import (
    CATEGORY_KEYWORDS, PAYWALL_DOMAINS, PAYWALL_TERMS, SECTION_RULES, SOURCE_BOOSTS, STOP_WORDS,
    SUBCATEGORY_KEYWORDS, TECHNICAL_TERMS,
)

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NON_WS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def occurrences(text: str, keyword: str) -> str:
    return f"((length({text}) - length(replace({text}, {lit(keyword)}, ''))) // {len(keyword)})"


def word_list(text: str) -> str:
    return f"regexp_extract_all({text}, '{NON_WS}+')"


def word_count(text: str) -> str:
    return f"CAST(coalesce(len({word_list(text)}), 0) AS BIGINT)"


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{WS}+', ''), '{WS}+$', '')"


def normalize(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def truncate_chars(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) > {n} THEN left({text}, {n}) || '...' ELSE {text} END"


def truncate_words(text: str, n: int) -> str:
    return (
        f"CASE WHEN len({word_list(text)}) > {n} "
        f"THEN array_to_string(({word_list(text)})[1:{n}], ' ') || '...' ELSE {text} END"
    )


def strip_tags(text: str) -> str:
    return normalize(f"regexp_replace({text}, '<[^>]*>', ' ', 'g')")


def sentences(text: str) -> str:
    """Exceptions are protected by a mark, then every remaining break is a split point."""
    marked = (
        f"regexp_replace({text}, '([A-Z][a-z]\\.|{W}\\.{W}[.?!])({WS})', '\\1' || chr(2) || '\\2', 'g')"
    )
    split = f"regexp_replace({marked}, '([.?!]){WS}', '\\1' || chr(3), 'g')"
    parts = f"string_split(replace({split}, chr(2), ''), chr(3))"
    trimmed = f"list_transform({parts}, lambda s: {strip('s')})"
    return f"list_filter({trimmed}, lambda s: s <> '')"


def lead_summary(text: str) -> str:
    s = sentences(text)
    lead = f"array_to_string(({s})[1:3], ' ')"
    return (
        f"CASE WHEN {text} = '' THEN '' WHEN len({s}) <= 3 THEN array_to_string({s}, ' ') "
        f"ELSE {truncate_chars(lead, 500)} END"
    )


def scrub(text: str) -> str:
    for pattern, flags in (
        (r"<\s*!DOCTYPE.*?>", "gis"), (r"<html.*?>.*?</html>", "gis"), (r"<\s*meta.*?>", "gi"),
        (r"<\s*link.*?>", "gi"), (r"<\s*script.*?>.*?</\s*script\s*>", "gis"),
        (r"<\s*style.*?>.*?</\s*style\s*>", "gis"),
    ):
        text = f"regexp_replace({text}, '{pattern}', '', '{flags}')"
    return text


def strip_boilerplate(html: str) -> str:
    html = f"regexp_replace({html}, '<!--.*?-->', '', 'gs')"
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        html = f"regexp_replace({html}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'gis')"
    return html


def unescape(text: str) -> str:
    for entity, value in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"),
        ("&middot;", "·"), ("&amp;", "&"),
    ):
        text = f"replace({text}, {lit(entity)}, {lit(value)})"
    return text


CLEAN_PAGES = f"clean AS (SELECT page_id, url, html, {strip_boilerplate('html')} AS page FROM pages)"
MAIN_PAGES = (
    CLEAN_PAGES
    + ", main AS (SELECT *, regexp_extract(page, '<article\\b[^>]*>(.*?)</article\\s*>', 1, 'is') AS part FROM clean)"
)
PAGE_BLOCKS = (
    MAIN_PAGES
    + ", pieces AS (SELECT page_id, url, html, part, unnest(string_split(regexp_replace(regexp_replace(part, "
    "'<(?:p|h[1-6])(?:\\s[^>]*)?>', chr(1) || '+', 'gi'), '</(?:p|h[1-6])\\s*>', chr(1), 'gi'), chr(1))) AS piece, "
    "generate_subscripts(string_split(regexp_replace(regexp_replace(part, "
    "'<(?:p|h[1-6])(?:\\s[^>]*)?>', chr(1) || '+', 'gi'), '</(?:p|h[1-6])\\s*>', chr(1), 'gi'), chr(1)), 1) AS i FROM main)"
    ", texts AS (SELECT page_id, url, html, i, "
    + unescape(strip(f"regexp_replace(substr(piece, 2), '(?:{WS}*<[^>]*>)+{WS}*', '', 'g')"))
    + " AS block FROM pieces WHERE starts_with(piece, '+'))"
    ", blocks AS (SELECT page_id, i, block FROM texts WHERE block <> '')"
)
PAGE_TEXT = (
    PAGE_BLOCKS
    + ", page_text AS (SELECT m.page_id, m.url, m.html, "
    + normalize(scrub("coalesce(string_agg(b.block, chr(10) || chr(10) ORDER BY b.i), '')"))
    + " AS text FROM main m LEFT JOIN blocks b USING (page_id) GROUP BY m.page_id, m.url, m.html)"
)

ARTICLES = (
    "art AS (SELECT CAST(1 AS BIGINT) AS feed_ord, doc_id AS entry_ord, split_part(text, chr(10), 1) AS title, "
    "'https://' || source || '.example.com/' || doc_id AS url, source, '' AS summary, text AS full_text, "
    "text AS content FROM documents)"
)


def has_code(text: str) -> str:
    return f"regexp_matches({text}, '```|\\{{|\\}}|function|class|def|return|import')"


def technical_terms(text: str) -> str:
    return "CAST(" + " + ".join(f"(contains(lower({text}), {lit(t)}))::INT" for t in TECHNICAL_TERMS) + " AS BIGINT)"


def any_of(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(t)})" for t in terms) + ")"


def host(url: str) -> str:
    authority = f"regexp_extract(lower({url}), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1)"
    return f"regexp_replace(regexp_replace({authority}, '^.*@', ''), ':\\d*$', '')"


def on_paywall_domain(url: str) -> str:
    h = host(url)
    return "(" + " OR ".join(f"{h} = {lit(d)} OR ends_with({h}, {lit('.' + d)})" for d in PAYWALL_DOMAINS) + ")"


def paywalled(text: str, url: str) -> str:
    return (
        f"({any_of(f'lower({text})', PAYWALL_TERMS)} OR ({on_paywall_domain(url)} AND length({text}) < 1000))"
    )


def _sum(text: str, words: list[str]) -> str:
    return "CAST(" + " + ".join(occurrences(text, k) for k in words) + " AS BIGINT)"


def _boost(source: str, category: str) -> str:
    for cat, terms, weight in SOURCE_BOOSTS:
        if cat == category:
            return f"CASE WHEN {any_of(f'lower({source})', terms)} THEN {weight} ELSE 0 END"
    return "0"


def scored(name: str, origin: str, text: str, title: str, source: str | None) -> str:
    """CTE ``name``: rows of ``origin`` with ``scores`` (list in declared order)."""
    sums = [
        f"{_sum('low', words)} + " + (_boost(source, cat) if source else "0")
        for cat, words in CATEGORY_KEYWORDS.items()
    ]
    weighted = f"lower({title} || ' ' || {title} || ' ' || {text})"
    return (
        f"{name}_low AS (SELECT *, {weighted} AS low FROM {origin}), "
        f"{name} AS (SELECT * EXCLUDE (low), [{', '.join(sums)}] AS scores FROM {name}_low)"
    )


CATEGORY_LIST = "[" + ", ".join(lit(c) for c in CATEGORY_KEYWORDS) + "]"


def classified(origin: str = "art", text: str = "full_text", title: str = "title", source: str | None = "source") -> str:
    """CTE ``cls``: rows of ``origin`` with category, category_score and subcategory."""
    subs = []
    for cat, groups in SUBCATEGORY_KEYWORDS.items():
        names = "[" + ", ".join(lit(s) for s in groups) + "]"
        sums = "[" + ", ".join(_sum("body_low", words) for words in groups.values()) + "]"
        best = f"list_max({sums})"
        subs.append(
            f"WHEN category = {lit(cat)} THEN CASE WHEN {best} > 0 "
            f"THEN {names}[list_position({sums}, {best})] END"
        )
    return (
        scored("scored_rows", origin, text, title, source)
        + ", picked AS (SELECT *, list_max(scores) AS best, list_sum(scores) AS total FROM scored_rows)"
        + f", main_cat AS (SELECT * EXCLUDE (scores, best, total), lower({text}) AS body_low, "
        f"CASE WHEN best = 0 OR ({text} = '' AND {title} = '') THEN 'Other' ELSE {CATEGORY_LIST}[list_position(scores, best)] END AS category, "
        f"CASE WHEN best = 0 OR ({text} = '' AND {title} = '') THEN 0.0 ELSE best / total END AS category_score FROM picked)"
        + f", cls AS (SELECT * EXCLUDE (body_low), CASE {' '.join(subs)} END AS subcategory FROM main_cat)"
    )


def section_scores(text: str) -> dict[str, str]:
    return {name: _sum(text, rule["keywords"]) for name, rule in SECTION_RULES.items()}


def plain_words(text: str) -> str:
    """Lower-case ASCII words of 3 to 15 letters without stop words, by cutting into word runs first."""
    runs = f"regexp_extract_all(lower({text}), '{W}+')"
    stops = "[" + ", ".join(lit(s) for s in STOP_WORDS) + "]"
    return (
        f"list_filter({runs}, lambda w: regexp_full_match(w, '[a-zA-Z]{{3,15}}') "
        f"AND NOT list_contains({stops}, w))"
    )


ISSUE = "2024-02-05"
ISSUE_LONG = "February 05, 2024"


def basic_block(body: str, author: str = "''", published: str = "''") -> str:
    return (
        f"'### [' || title || '](' || url || ')' || chr(10) || chr(10) || '**Author:** ' || {author} || chr(10) || "
        f"'**Source:** ' || coalesce(source, '') || chr(10) || '**Published:** ' || {published} || chr(10) || "
        "'**Classification:** ' || category || chr(10) || '**Subcategory:** ' || "
        "coalesce(nullif(subcategory, ''), 'N/A') || chr(10) || chr(10) || "
        f"{truncated(body)} || chr(10) || chr(10) || '[Read more](' || url || ')' || chr(10)"
    )


def truncated(body: str) -> str:
    return f"({truncate_chars(body, 500)})"
