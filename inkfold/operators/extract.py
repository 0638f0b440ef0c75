"""Page extraction: raw page -> text, images, features; stored text -> word-limited HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions.features import article_features
from inkfold.functions.html import (
    block_texts, extract_images, is_html, main_content, main_text, needs_tree, scrub_html,
    strip_boilerplate,
)
from inkfold.functions.text import (
    blank_if_null, is_malformed_html, normalize_ws, repair_kind, repair_split_text, strip_tags,
    truncate_words,
)
from inkfold.functions.tree import budget_blocks_udf, main_fragment_udf


def with_main(pages: DataFrame, html: str = "html", tree: bool = True) -> DataFrame:
    """Add ``_clean`` (page without boilerplate), ``_main`` (its main part) and ``_from_body``.

    ``tree=True`` sends pages the expressions cannot cut rightly to the tag-matching helper; all other
    rows hand it a null.
    """
    out = pages.withColumn("_clean", strip_boilerplate(html))
    regex_main = main_content("_clean")
    if tree:
        out = out.withColumn("_tree", main_fragment_udf(F.when(needs_tree("_clean"), F.col("_clean"))))
        main = F.coalesce("_tree", regex_main)
    else:
        out = out.withColumn("_tree", F.lit(None).cast("string"))
        main = regex_main
    from_body = F.col("_tree").isNull() & ~blank_if_null("_clean").rlike(r"(?i)<article\b")
    return out.withColumns({"_main": main, "_from_body": from_body})


def extract_text(pages: DataFrame, html: str = "html", name: str = "text", tree: bool = True) -> DataFrame:
    """Add the readable text of a page."""
    out = with_main(pages, html, tree).withColumn("_blocks", block_texts("_main"))
    return out.withColumn(name, main_text("_main", "_blocks")).drop(
        "_clean", "_tree", "_main", "_from_body", "_blocks"
    )


def with_images(pages: DataFrame, html: str = "html", tree: bool = True) -> DataFrame:
    """Add the images of the main part; of the first five of the whole page when there is no main part."""
    out = with_main(pages, html, tree)
    images = F.when(F.col("_from_body"), extract_images("_clean", first=5)).otherwise(extract_images("_main"))
    return out.withColumn("images", images).drop("_clean", "_tree", "_main", "_from_body")


def process_pages(pages: DataFrame, html: str = "html", url: str = "url", tree: bool = True) -> DataFrame:
    """Text and features of every page; the raw page is dropped."""
    out = with_main(pages, html, tree).withColumn("_blocks", block_texts("_main"))
    images = F.when(F.col("_from_body"), extract_images("_clean", first=5)).otherwise(extract_images("_main"))
    out = out.withColumn("text", main_text("_main", "_blocks")).withColumn("_images", images)
    return out.withColumn("features", article_features("text", html, url, F.col("_images"))).drop(
        html, "_clean", "_tree", "_main", "_from_body", "_blocks", "_images"
    )


def extract_paragraphs(
    df: DataFrame, text: str, limit: int = 500, name: str = "extracted", kind: str | None = None
) -> DataFrame:
    """Add word-limited HTML of a stored text; ``kind`` names an optional column telling the path taken.

    Split-character damage is repaired first; proper HTML keeps whole blocks up to the limit; anything
    else is plain text in one paragraph.
    """
    out = df.withColumn("_repair", repair_kind(text))
    markup = F.col("_repair").isNull() & F.coalesce(is_html(text), F.lit(False))
    out = out.withColumn("_scrubbed", F.when(F.col("_repair").isNull(), scrub_html(text)))
    out = out.withColumn("_markup", markup & ~F.coalesce(is_malformed_html("_scrubbed"), F.lit(False)))
    out = out.withColumn(
        "_blocks", budget_blocks_udf(F.when(F.col("_markup"), F.col("_scrubbed")), limit)
    )
    plain = normalize_ws(strip_tags("_scrubbed"))
    out = out.withColumn("_plain", F.when(F.col("_repair").isNull() & ~F.col("_markup"), plain))
    wrapped = F.when(F.col("_plain") != "", F.concat(F.lit("<p>"), truncate_words("_plain", limit), F.lit("</p>\n\n")))
    result = F.coalesce(repair_split_text(text, "_repair", limit), F.col("_blocks"), wrapped, F.lit(""))
    out = out.withColumn(name, result)
    if kind:
        path = F.coalesce(
            F.col("_repair"), F.when(F.col("_markup"), "html").when(F.col("_plain") != "", "plain")
        )
        out = out.withColumn(kind, F.coalesce(path, F.lit("empty")))
    return out.drop("_repair", "_scrubbed", "_markup", "_blocks", "_plain")
