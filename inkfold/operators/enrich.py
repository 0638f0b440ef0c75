"""Content choice, page and cache joins, stored model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.blocks import block_basic
from inkfold.functions.text import (
    WS, blank_if_null, domain, first_non_empty, format_published, has_words, reading_time, strip,
    word_count,
)
from inkfold.operators.classify import classify, with_subcategory
from inkfold.operators.dedup import url_key
from inkfold.operators.extract import process_pages
from inkfold.rules import DEFAULT_RULES, RuleSet
from inkfold.schemas import FEATURES_DDL
from inkfold.sources.cache import cache_expire

THIN_WORDS = 50
FAILED_NOTE = "**Note: Full article content could not be retrieved.**"
META_COLUMNS = ("title", "source", "url", "author", "published", "image_url")


def thin_content(content: Column | str = "content") -> Column:
    return ~has_words(content, THIN_WORDS)


def choose_content(
    content: Column | str = "content", full_text: Column | str = "full_text",
    summary: Column | str = "summary", title: Column | str = "title", source: Column | str = "source",
) -> Column:
    """Content, else full text, else summary, else a line made of title and source."""
    line = F.concat(F.lit("Article titled: "), blank_if_null(title), F.lit(" from "), blank_if_null(source))
    return F.coalesce(first_non_empty(content, full_text, summary), line)


def choose_after_fetch(
    fetched: Column | str, full_text: Column | str = "full_text", summary: Column | str = "summary"
) -> Column:
    """Fetched text unless it is still thin and the feed has something."""
    f = blank_if_null(fetched)
    return F.when(~thin_content(f), f).otherwise(F.coalesce(first_non_empty(full_text, summary), f))


def local_body(full_text: Column | str = "full_text", summary: Column | str = "summary") -> Column:
    return F.coalesce(first_non_empty(full_text, summary), F.lit(""))


def fill_blank(articles: DataFrame) -> DataFrame:
    return articles.na.fill("", subset=[c for c in META_COLUMNS if c in articles.columns])


def failed_rows(articles: DataFrame) -> DataFrame:
    """Give failed articles the note as content and no category."""
    failed = F.col("status") == "failed"
    return articles.withColumns(
        {
            "content": F.when(failed, FAILED_NOTE).otherwise(F.col("content")),
            "processed_content": F.when(failed, FAILED_NOTE).otherwise(F.col("processed_content")),
            "category": F.when(failed, "Unclassified").otherwise(F.col("category")),
        }
    )


def processed_and_failed(processed: DataFrame, failed: DataFrame) -> DataFrame:
    """One table of all articles with a status; it feeds every output."""
    ok = processed.withColumn("status", F.lit("processed"))
    bad = failed.withColumn("status", F.lit("failed"))
    return failed_rows(ok.unionByName(bad, allowMissingColumns=True))


# --- cache table -------------------------------------------------------------------------------


def fresh_cache(cache: DataFrame, as_of: Column | str, days: int = 7, refresh: bool = False) -> DataFrame:
    """Rows younger than the cache life at ``as_of``; none with ``refresh``."""
    return cache.filter(F.lit(False)) if refresh else cache_expire(cache, as_of, days)


def one_per_url(rows: DataFrame, newest: str, *values: str) -> DataFrame:
    """One row per URL, so that a join by URL adds none: the greatest ``newest``, ties by the greatest values.

    ``row_number() = 1`` is planned with a rank limit before the shuffle: each task sends one row per URL, however
    often that URL is repeated.
    """
    columns = list(dict.fromkeys((newest, *values)))
    first = Window.partitionBy("url").orderBy(*[F.desc(c) for c in columns])
    ranked = rows.filter(F.col("url").isNotNull()).select("url", *columns).withColumn("_rank", F.row_number().over(first))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def with_cache(
    articles: DataFrame, cache: DataFrame, as_of: Column | str, days: int = 7, refresh: bool = False
) -> DataFrame:
    """Add ``cached_content``, ``cached_features`` (struct) and ``from_cache``; of repeated URLs the newest row."""
    fresh = one_per_url(fresh_cache(cache, as_of, days, refresh), "cached_at", "content", "features").select(
        F.col("url").alias("_url_key"),
        F.col("content").alias("cached_content"),
        F.from_json("features", FEATURES_DDL).alias("cached_features"),
        F.lit(True).alias("from_cache"),
    )
    return (
        articles.withColumn("_url_key", url_key())
        .join(fresh, "_url_key", "left")
        .withColumn("from_cache", F.coalesce("from_cache", F.lit(False)))
        .drop("_url_key")
    )


# --- stored pages ------------------------------------------------------------------------------


def with_pages(articles: DataFrame, pages: DataFrame, tree: bool = True, newest: str = "html") -> DataFrame:
    """Thin articles take the text of their summary, or of their stored page where the feed gave no summary.

    Both are read as pages: the text is extracted and gives the ``features``; where it is thin as well, the full text
    or the summary as it stands is taken. ``fetched`` tells who took a page. Only thin rows without a summary are
    shuffled, and only pages they match are extracted. Of pages with one URL the one with the greatest ``newest`` is
    taken (by default the greatest text, so that the choice is fixed).
    """
    rest = articles.filter(~thin_content()).withColumns(
        {"features": F.lit(None).cast(FEATURES_DDL), "fetched": F.lit(False)})
    thin = articles.filter(thin_content()).withColumn("_summary", blank_if_null("summary"))
    own = thin.filter(F.col("_summary") != "").withColumns({"html": F.col("_summary"), "fetched": F.lit(False)})
    stored = one_per_url(pages, newest, "html").select(F.col("url").alias("_url_key"), "html")
    joined = (thin.filter(F.col("_summary") == "").withColumn("_url_key", url_key())
              .join(stored, "_url_key", "left").drop("_url_key").withColumn("fetched", F.col("html").isNotNull()))
    both = own.unionByName(joined).withColumn("_found", F.col("html").isNotNull())
    read = process_pages(both, tree=tree).withColumns(
        {"features": F.when(F.col("_found"), F.col("features")),
         "content": F.when(F.col("_found"), choose_after_fetch("text")).otherwise(F.col("content"))})
    cols = [*articles.columns, "features", "fetched"]
    return rest.select(cols).unionByName(read.select(cols))


def enrich_content(
    articles: DataFrame, pages: DataFrame, cache: DataFrame, as_of: Column | str, days: int = 7,
    refresh: bool = False, tree: bool = True,
) -> DataFrame:
    """Content and features of thin articles: from the cache where it is fresh, else from the page.

    ``content_from`` is ``feed``, ``cache`` or ``page``; rows found in the cache skip extraction.
    """
    plain = articles.filter(~thin_content()).withColumns(
        {"features": F.lit(None).cast(FEATURES_DDL), "content_from": F.lit("feed")}
    )
    looked_up = with_cache(articles.filter(thin_content()), cache, as_of, days, refresh)
    cols = [*articles.columns, "features", "content_from"]
    hits = looked_up.filter("from_cache").withColumns(
        {"content": choose_after_fetch("cached_content"), "features": F.col("cached_features"),
         "content_from": F.lit("cache")}
    )
    misses = with_pages(looked_up.filter("not from_cache").select(articles.columns), pages, tree).withColumn(
        "content_from", F.when(F.col("fetched"), "page").otherwise("feed")
    )
    return plain.select(cols).unionByName(hits.select(cols)).unionByName(misses.select(cols))


# --- stored model responses --------------------------------------------------------------------

SYSTEM_PROMPT = (
    "Format the article below as clean Markdown and classify it into one of: Tech News, AI, Industry "
    "Analysis, Venture Capital, Programming, Science, Startups, Essays, Other. Answer with a JSON object "
    "with the fields category, subcategory and formatted_markdown."
)


def prompt_rows(articles: DataFrame, system: str = SYSTEM_PROMPT) -> DataFrame:
    """One request text per article for an offline batch model job."""
    fields = [
        ("Article Title", blank_if_null("title")), ("Article URL", blank_if_null("url")),
        ("Source", blank_if_null("source")), ("Author", blank_if_null("author")),
        ("Published Date", blank_if_null(format_published("published"))),
        ("Image URL", blank_if_null("image_url")),
    ]
    head = [F.concat(F.lit(f"{label}: "), value) for label, value in fields]
    prompt = F.concat_ws("\n", *head, F.lit(""), F.lit("Content:"), choose_content())
    return articles.select("feed_ord", "entry_ord", "url", F.lit(system).alias("system"), prompt.alias("prompt"))


def _last_keys(raw: Column) -> Column:
    """The fields of an object whose keys are repeated, as JSON with their last values; null for any other text.

    The parser of variants refuses repeated keys. This one takes the last, but would also read an object with text
    behind it, so the object is read as the only element of a list.
    """
    ddl = "array<struct<category:string,subcategory:string,formatted_markdown:string,confidence:string>>"
    trimmed = F.trim(raw, F.lit(" \t\r\n"))
    read = F.from_json(F.concat(F.lit("["), trimmed, F.lit("]")), ddl, {"allowSingleQuotes": "false"})
    framed = trimmed.startswith("{") & trimmed.endswith("}")
    return F.when(framed & (F.size(read) == 1), F.to_json(F.get(read, F.lit(0))))


def parse_response(responses: DataFrame, response: str = "response") -> DataFrame:
    """Add ``is_json`` and the fields of a stored model response.

    A JSON object gives its fields with their defaults. Any other text gives what its ``Category:`` and
    ``Subcategory:`` lines say (null without one) and itself as the body. ``other_json`` marks JSON that is no
    object (a list, a number): it answers nothing. Of a key that an object repeats the last value counts.
    """
    raw = F.col(response)
    out = responses.withColumn("_variant", F.coalesce(F.try_parse_json(raw), F.try_parse_json(_last_keys(raw))))
    out = out.withColumn("is_json", F.coalesce(F.schema_of_variant("_variant").startswith("OBJECT"), F.lit(False)))
    out = out.withColumn("other_json", F.col("_variant").isNotNull() & ~F.col("is_json"))

    def field(name: str) -> Column:
        return F.try_variant_get("_variant", f"$.{name}", "string")

    def line(label: str) -> Column:
        pattern = rf"(?id){label}:{WS}*(.*?)[\n\r]"
        return F.when(raw.rlike(pattern), strip(F.regexp_extract(raw, pattern, 1)))

    is_json = F.col("is_json")
    number = F.schema_of_variant(F.try_variant_get("_variant", "$.confidence", "variant"))
    numeric = number.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") | field("confidence").rlike(r"^(\d+\.?\d*|\.\d+)\z")
    return out.withColumns(
        {
            "r_category": F.when(is_json, F.coalesce(field("category"), F.lit("Unclassified"))).otherwise(line("Category")),
            "r_subcategory": F.when(is_json, F.coalesce(field("subcategory"), F.lit("N/A"))).otherwise(line("Subcategory")),
            "r_markdown": F.when(is_json, F.coalesce(field("formatted_markdown"), F.lit(""))).otherwise(raw),
            "r_confidence": F.when(is_json & numeric, field("confidence").try_cast("double")),
        }
    ).drop("_variant")


def with_responses(articles: DataFrame, responses: DataFrame) -> DataFrame:
    """Left join of parsed responses by URL; of repeated URLs the greatest response by text."""
    parsed = parse_response(one_per_url(responses, "response")).select(
        F.col("url").alias("_url_key"), (F.col("response").isNotNull() & ~F.col("other_json")).alias("_answered"),
        "is_json", "r_category", "r_subcategory", "r_markdown", "r_confidence",
    )
    return articles.withColumn("_url_key", url_key()).join(parsed, "_url_key", "left").drop("_url_key")


def resolve_enrichment(
    articles: DataFrame, responses: DataFrame, issue_body: int = 500, rules: RuleSet = DEFAULT_RULES
) -> DataFrame:
    """Category, subcategory and body of every article: JSON response, else its lines, else the rules.

    ``resolved_by`` is ``json``, ``text`` or ``rules``. Domain and reading time are always set.
    """
    out = with_responses(articles, responses).withColumn("_body", choose_content())
    answered = F.coalesce("_answered", F.lit(False))
    # The rules read a text only where the response leaves something open.
    open_category = F.when(~answered | F.col("r_category").isNull(), F.col("_body"))
    open_subcategory = F.when(~answered | F.col("r_subcategory").isNull(), F.col("_body"))
    out = classify(out, open_category, rules=rules).withColumnsRenamed(
        {"category": "_rule_category", "category_score": "_rule_score"}
    )
    is_json = answered & F.col("is_json")
    out = out.withColumn(
        "category", F.when(answered, F.coalesce("r_category", "_rule_category")).otherwise(F.col("_rule_category"))
    )
    out = with_subcategory(out, open_subcategory, rules=rules, name="_rule_subcategory")
    score = F.when(is_json, F.col("r_confidence")).when(~answered, F.col("_rule_score"))
    out = out.withColumns(
        {
            "subcategory": F.when(answered, F.coalesce("r_subcategory", "_rule_subcategory")).otherwise(F.col("_rule_subcategory")),
            "category_score": score,
            "resolved_by": F.when(is_json, "json").when(answered, "text").otherwise("rules"),
            "domain": domain(blank_if_null("url")),
            "reading_time": reading_time(word_count("_body")),
        }
    )
    out = out.withColumn(
        "processed_content",
        F.when(answered, F.col("r_markdown")).otherwise(block_basic(F.col("_body"), issue_body)),
    )
    return out.drop(
        "_answered", "is_json", "r_category", "r_subcategory", "r_markdown", "r_confidence",
        "_body", "_rule_category", "_rule_score", "_rule_subcategory",
    )
