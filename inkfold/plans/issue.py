"""The end-to-end job: feeds -> classified article table -> digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions.blocks import block_basic
from inkfold.functions.features import article_features, paywall_flag
from inkfold.functions.text import blank_if_null, domain, parse_published, reading_time, word_count
from inkfold.operators.classify import classify_articles
from inkfold.operators.dedup import dedupe_by_url, limit_per_feed
from inkfold.operators.digest import (
    contents, marked_reading_list, newsletter, reading_list, sectioned_newsletter, snippets,
)
from inkfold.operators.enrich import enrich_content, local_body, resolve_enrichment, with_pages
from inkfold.rules import DEFAULT_RULES, RuleSet
from inkfold.schemas import FEATURES_DDL
from inkfold.session import written
from inkfold.sources.sinks import write_digest_html, write_digest_md

DIGESTS = {
    "newsletter": newsletter, "newsletter_sections": sectioned_newsletter, "reading_list": reading_list,
    "reading_list_marked": marked_reading_list, "snippets": snippets, "contents": contents,
}


def process_articles(
    articles: DataFrame, issue: str | Column, rules: RuleSet = DEFAULT_RULES, responses: DataFrame | None = None,
    features: bool = False,
) -> DataFrame:
    """Domain, category, subcategory, reading time, paywall flag and block of every article.

    Rules decide; with ``responses`` (stored model answers) they decide what those leave open. Features that are
    there (of a page or the cache) stay; with ``features`` the others are made from the body, which no digest needs.
    """
    out = articles.withColumns(
        {
            "issue": F.lit(issue) if isinstance(issue, str) else issue,
            "domain": domain(blank_if_null("url")),
            "_body": local_body(),
        }
    )
    made = article_features("_body", "_body", "url") if features else F.lit(None).cast(FEATURES_DDL)
    out = out.withColumns(
        {
            "features": F.coalesce("features", made) if "features" in out.columns else made,
            "published_ts": F.col("published_ts") if "published_ts" in out.columns else parse_published("published"),
        }
    )
    if responses is None:
        out = classify_articles(out, "_body", rules=rules).withColumns(
            {"reading_time": reading_time(word_count("full_text")), "processed_content": block_basic(F.col("_body"))})
    else:
        out = resolve_enrichment(out.drop("_body"), responses, rules=rules).withColumn("_body", local_body())
    out = out.withColumns(
        {
            "is_paywalled": paywall_flag("_body", "url"),
            "status": F.lit("processed"),
            "article_id": F.when(blank_if_null("url") != "", F.sha2("url", 256)).otherwise(
                F.concat_ws(":", F.col("feed_ord").cast("string"), F.col("entry_ord").cast("string"))),
        }
    )
    return out.drop("_body")


def build_issue(
    spark: SparkSession, articles: DataFrame, issue: str, out: str, kinds: tuple[str, ...] = ("newsletter", "reading_list"),
    html: bool = True, rules: RuleSet = DEFAULT_RULES, limit: int = 0, pages: DataFrame | None = None,
    cache: DataFrame | None = None, as_of: str | Column | None = None, responses: DataFrame | None = None,
    features: bool = False,
) -> DataFrame:
    """Limit, de-duplicate, enrich, process and write the digests of one issue; returns the processed table.

    Thin articles take their text from ``cache`` (rows fresh at ``as_of``), else from ``pages``; ``responses`` are
    stored model answers. Each of them may be left out; a cache needs ``as_of``. The table has the features of pages
    and of the cache; with ``features`` those of all articles.
    """
    found = dedupe_by_url(limit_per_feed(articles, limit))
    if cache is not None:
        if as_of is None:
            raise ValueError("a cache needs as_of")
        stored = pages if pages is not None else spark.createDataFrame([], "url string, html string")
        found = enrich_content(found, stored, cache, as_of)
    elif pages is not None:
        found = with_pages(found, pages)
    table = written(process_articles(found, issue, rules, responses, features), "articles")
    for kind in kinds:
        lines = DIGESTS[kind](table)
        write_digest_md(lines, f"{out}/md/{kind}")
        if html:
            write_digest_html(lines, f"{out}/html/{kind}")
    return table
