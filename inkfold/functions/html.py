"""Page functions: boilerplate removal, main content, block texts, images. Column -> Column."""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.functions.text import WS, as_col, blank_if_null, count_occurrences, let, normalize_ws, strip

# Elements that are never content, and class words that mark the main part.
BOILERPLATE_TAGS = ("script", "style", "nav", "footer", "header", "aside")
MAIN_CLASS_TERMS = ("article", "content", "post", "entry")
BLOCK_MARK = "\x01"
TAG_MARK = "\x02"

# What is removed from a text that may hold page remains, in this order.
SCRUB_PATTERNS = (
    r"(?is)<\s*!DOCTYPE.*?>",
    r"(?is)<html.*?>.*?</html>",
    r"(?id)<\s*meta.*?>",
    r"(?id)<\s*link.*?>",
    r"(?is)<\s*script.*?>.*?</\s*script\s*>",
    r"(?is)<\s*style.*?>.*?</\s*style\s*>",
)

# An open tag followed by a close tag.
HTML_PATTERN = r"(?s)<[a-zA-Z][^>]*>(.*?)</[a-zA-Z][^>]*>"

# Every name of the standard, by the standard library's table.
ENTITIES = {f"&{name}": value for name, value in html5.items() if name.endswith(";")}
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


def is_html(text: Column | str) -> Column:
    """True when the text has an open tag followed by a close tag."""
    return as_col(text).rlike(HTML_PATTERN)


def strip_boilerplate(html: Column | str) -> Column:
    """Drop script, style, nav, footer, header and aside elements and comments."""
    h = F.regexp_replace(as_col(html), r"(?s)<!--.*?-->", "")
    for tag in BOILERPLATE_TAGS:
        h = F.regexp_replace(h, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return h


def main_content(html: Column | str) -> Column:
    """The article element, else the body, else the whole text.

    A page without ``article`` whose main part is marked by class, or with nested articles, needs a
    tree; ``needs_tree`` tells, and ``operators.extract`` sends those rows to a small parser.
    """
    h = as_col(html)
    article = F.regexp_extract(h, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    body = F.regexp_extract(h, r"(?is)<body\b[^>]*>(.*)</body\s*>", 1)

    def filled(part: Column) -> Column:
        return let(part, lambda p: F.nullif(p, F.lit("")))

    return F.coalesce(filled(article), filled(body), h)


def needs_tree(html: Column | str) -> Column:
    h = as_col(html)
    opens = F.regexp_count(h, F.lit(r"(?i)<article\b"))
    closes = F.regexp_count(h, F.lit(r"(?i)</article\s*>"))
    terms = "|".join(MAIN_CLASS_TERMS)
    by_class = h.rlike(
        rf"(?is)<[a-z][^>]*\bclass\s*=\s*(?:\"[^\">]*(?:{terms})|'[^'>]*(?:{terms})|[^\s\"'>]*(?:{terms}))"
    )
    unclosed = (opens == 1) & (closes != 1)
    return blank_if_false((opens > 1) | unclosed | ((opens == 0) & by_class))


def blank_if_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def unescape(text: Column | str) -> Column:
    """Decode named and numeric references, each once; unknown names stay as they are."""
    names = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in ENTITIES.items())), F.lit("\x01"), F.lit("\x02"))

    def char(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"&#[xX]?([0-9a-fA-F]+);", 1)
        code = F.when(F.lower(ref).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        safe = F.when(valid, code).otherwise(F.lit(0xFFFD))
        return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")

    def value(ref: Column) -> Column:
        return F.when(F.startswith(ref, F.lit("&#")), char(ref)).otherwise(
            F.coalesce(F.try_element_at(names, ref), ref))

    def joined(parts: Column) -> Column:
        values = let(F.array_distinct(parts["refs"]), lambda d: F.map_from_arrays(d, F.transform(d, value)))
        return let(values, lambda m: F.array_join(F.zip_with(
            parts["gaps"], parts["refs"],
            lambda gap, ref: F.concat(gap, F.coalesce(F.try_element_at(m, ref), F.lit("")))), ""))

    def decode(t: Column) -> Column:
        parts = F.struct(F.split(t, REFERENCE, -1).alias("gaps"),
                         F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)).alias("refs"))
        return F.when(t.rlike(REFERENCE), let(parts, joined)).otherwise(t)

    return let(as_col(text), decode)


def node_text(fragment: Column | str, sep: str = "") -> Column:
    """Text of a fragment: every text node stripped, then joined by ``sep``.

    Tags become marks first, so that a run of them is a loop over one character class; a repeated group would be
    matched by recursion, which some hundreds of tags in a row exhaust.
    """
    marked = F.regexp_replace(F.replace(as_col(fragment), F.lit(TAG_MARK), F.lit(" ")), "<[^>]*>", TAG_MARK)
    bare = F.regexp_replace(marked, rf"(?<!{WS}){WS}*+{TAG_MARK}[{TAG_MARK}{WS}]*+", sep)
    return unescape(strip(bare))


def block_texts(main: Column | str) -> Column:
    """Texts of ``p`` and ``h1``..``h6`` in document order; a block ends at the next block tag."""
    marked = F.regexp_replace(as_col(main), r"(?i)<(?:p|h[1-6])(?:\s[^>]*)?>", BLOCK_MARK + "+")
    marked = F.regexp_replace(marked, r"(?i)</(?:p|h[1-6])\s*>", BLOCK_MARK)
    opened = F.filter(F.split(marked, BLOCK_MARK), lambda s: F.startswith(s, F.lit("+")))
    texts = F.transform(opened, lambda s: node_text(F.substring(s, 2, 2**31 - 1)))
    return F.filter(texts, lambda s: s != "")


def scrub_html(text: Column | str) -> Column:
    """Remove doctype, a wrapped document, meta, link, script and style remains."""
    t = as_col(text)
    for pattern in SCRUB_PATTERNS:
        t = F.regexp_replace(t, pattern, "")
    return t


def main_text(main: Column | str, blocks: Column | str) -> Column:
    """Blocks by blank line; with no block, all text of the main part. Then scrub and normalise."""
    joined = F.array_join(as_col(blocks), "\n\n")
    text = F.coalesce(F.nullif(joined, F.lit("")), node_text(main, " "))
    return blank_if_null(normalize_ws(scrub_html(text)))


def link_count(html: Column | str) -> Column:
    return count_occurrences(blank_if_null(html), "href=")


def attribute(tag: Column, name: str) -> Column:
    """Value of one attribute of a tag, ``''`` when missing."""
    pattern = rf"(?is)\s{re.escape(name)}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def extract_images(fragment: Column | str, first: int | None = None) -> Column:
    """Images with a source, in order, first of each source, tiny ones dropped.

    ``first`` keeps that many ``img`` tags before the other rules, as the body fallback does.
    """
    tags = F.regexp_extract_all(as_col(fragment), F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    if first is not None:
        tags = F.slice(tags, 1, first)
    images = F.transform(
        tags,
        lambda t: F.struct(
            unescape(attribute(t, "src")).alias("src"),
            unescape(attribute(t, "alt")).alias("alt"),
            attribute(t, "width").alias("width"),
            attribute(t, "height").alias("height"),
        ),
    )
    return drop_tiny_images(first_of_each_source(F.filter(images, lambda i: i["src"] != "")))


def first_of_each_source(images: Column) -> Column:
    def firsts(all_images: Column) -> Column:
        return F.filter(
            all_images, lambda i, pos: F.array_position(all_images["src"], i["src"]) == pos + 1
        )

    return let(images, firsts)


def drop_tiny_images(images: Column) -> Column:
    """Drop an image when both sizes are numbers from 1 to 49; unreadable sizes keep it."""

    def tiny(i: Column) -> Column:
        w = F.trim(i["width"]).try_cast("int")
        h = F.trim(i["height"]).try_cast("int")
        return F.coalesce((w > 0) & (w < 50) & (h > 0) & (h < 50), F.lit(False))

    return F.filter(images, lambda i: ~tiny(i))
