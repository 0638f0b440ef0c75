"""Article blocks as Markdown text. Missing parts are skipped; every function returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.functions.text import blank_if_null, first_non_empty, format_published, truncate_chars

NO_CONTENT = "*No content available*"
LOCK = " \N{LOCK}"


def _filled(name: str) -> Column:
    return blank_if_null(name) != ""


def _label(label: str, value: Column, when: Column) -> Column:
    return F.when(when, F.concat(F.lit(f"**{label}:** "), value))


def link(text: Column, url: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]("), url, F.lit(")"))


def title_link() -> Column:
    return link(blank_if_null("title"), blank_if_null("url"))


def metadata_line() -> Column:
    """Author, source, published, classification, subcategory and domain on one line."""
    return F.concat_ws(
        " ",
        _label("Author", F.col("author"), _filled("author")),
        _label("Source", F.col("source"), _filled("source")),
        _label("Published", format_published("published"), _filled("published")),
        _label("Classification", F.col("category"), _filled("category")),
        _label("Subcategory", F.col("subcategory"), _filled("subcategory")),
        _label("Domain", F.col("domain"), _filled("domain")),
    )


def _minutes() -> Column:
    return F.concat(F.col("reading_time").cast("string"), F.lit(" min"))


def metadata_tabs() -> Column:
    """Source, author, published as given, reading time and domain by tab in a div; ``''`` if none."""
    has_time = F.coalesce(F.col("reading_time") > 0, F.lit(False))
    line = F.concat_ws(
        "\t",
        _label("Source", F.col("source"), _filled("source")),
        _label("Author", F.col("author"), _filled("author")),
        _label("Published", F.col("published"), _filled("published")),
        _label("Reading Time", _minutes(), has_time),
        _label("Domain", F.col("domain"), _filled("domain")),
    )
    return F.when(line != "", F.concat(F.lit('<div class="metadata">\n'), line, F.lit("\n</div>\n\n"))).otherwise("")


def metadata_lines() -> Column:
    """Source, date, category / subcategory and reading time on lines in a div."""
    category = F.concat(
        F.col("category"), F.when(_filled("subcategory"), F.concat(F.lit(" / "), F.col("subcategory"))).otherwise("")
    )
    has_time = F.coalesce(F.col("reading_time") > 0, F.lit(False))
    return F.concat_ws(
        "\n",
        F.lit('<div class="metadata">'),
        _label("Source", F.col("source"), _filled("source")),
        _label("Date", format_published("published"), _filled("published")),
        _label("Category", category, _filled("category")),
        _label("Reading time", _minutes(), has_time),
        F.lit("</div>"),
    )


def block_basic(body: Column, limit: int = 500) -> Column:
    """Linked title, five metadata lines, cut body, read-more link."""
    return F.concat(
        F.lit("### "), title_link(), F.lit("\n\n**Author:** "), blank_if_null("author"),
        F.lit("\n**Source:** "), blank_if_null("source"),
        F.lit("\n**Published:** "), blank_if_null(format_published("published")),
        F.lit("\n**Classification:** "), blank_if_null("category"),
        F.lit("\n**Subcategory:** "), F.coalesce(first_non_empty("subcategory"), F.lit("N/A")),
        F.lit("\n\n"), truncate_chars(body, limit), F.lit("\n\n"),
        link(F.lit("Read more"), blank_if_null("url")), F.lit("\n"),
    )


def block_full(content_extract: Column, full_text_extract: Column) -> Column:
    """Title, metadata line, image, body and link. The extracts are word-limited at 1500."""
    summary = F.coalesce(first_non_empty("summary"), F.lit(NO_CONTENT))
    body = (
        F.when(_filled("processed_content"), F.col("processed_content"))
        .when(_filled("content"), F.coalesce(
            F.nullif(content_extract, F.lit("")), F.nullif(full_text_extract, F.lit("")), summary))
        .otherwise(summary)
    )
    image = F.when(
        _filled("image_url"),
        F.concat(F.lit("!"), link(blank_if_null("title"), F.col("image_url")), F.lit("\n\n")),
    ).otherwise("")
    return F.concat(
        F.lit("### "), title_link(), F.lit("\n\n"), metadata_line(), F.lit("\n\n"), image, body,
        F.lit("\n\n"), link(F.lit("Read more"), blank_if_null("url")), F.lit("\n"),
    )


def block_original(full_text_extract: Column) -> Column:
    """Title, metadata in a div, full text at 500 words or summary, link, rule."""
    meta = metadata_line()
    div = F.when(meta != "", F.concat(F.lit('<div class="metadata">\n'), meta, F.lit("\n</div>\n"))).otherwise("")
    body = F.when(_filled("full_text"), F.concat(F.lit("\n"), full_text_extract, F.lit("\n"))).when(
        _filled("summary"), F.concat(F.lit("\n"), F.col("summary"), F.lit("\n"))
    ).otherwise("")
    more = F.when(
        _filled("read_more_url"),
        F.concat(F.lit("\n"), link(F.lit("Read more"), F.col("read_more_url")), F.lit("\n")),
    ).otherwise("")
    return F.concat(F.lit("## "), title_link(), F.lit("\n"), div, body, more, F.lit("\n---\n\n"))


def block_issue(extract: Column) -> Column:
    """Title, metadata lines, main image or image, body, link, rule.

    ``extract`` is the 1500-word extract of content, else of full text.
    """
    main_image = first_non_empty(F.col("features.main_image"), "image_url")
    image = F.when(
        main_image.isNotNull(),
        F.concat(F.lit("!"), link(blank_if_null("title"), main_image), F.lit("\n\n")),
    ).otherwise("")
    body = (
        F.when(_filled("processed_content"), F.col("processed_content"))
        .when(_filled("content") | _filled("full_text"), extract)
        .when(_filled("summary"), F.col("summary"))
        .otherwise(NO_CONTENT)
    )
    more = F.when(_filled("url"), F.concat(F.lit("\n\n"), link(F.lit("Read more"), F.col("url")))).otherwise("")
    return F.concat(
        F.lit("### "), blank_if_null("title"), F.lit("\n\n"), metadata_lines(), F.lit("\n\n"), image, body, more,
        F.lit("\n\n---\n"),
    )


def block_snippet(extract: Column, summary_words: Column) -> Column:
    """Linked title, tabbed metadata, 500-word body, link, rule."""
    body = F.when(_filled("content") | _filled("full_text"), F.concat(extract, F.lit("\n\n"))).when(
        _filled("summary"), F.concat(summary_words, F.lit("\n\n"))
    ).otherwise("")
    return F.concat(
        F.lit("### "), title_link(), F.lit("\n\n"), metadata_tabs(), body,
        link(F.lit("Read more"), blank_if_null("url")), F.lit("\n\n---\n"),
    )


def reading_item(marked: bool = False) -> Column:
    item = F.concat(F.lit("- "), title_link())
    return F.concat(item, F.when(F.coalesce("is_paywalled", F.lit(False)), LOCK).otherwise("")) if marked else item
