"""Markdown -> HTML rewrites of inline syntax and metadata. Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.functions.text import WORD, WS, as_col, strip

# The metadata div of a digest and what joins its pairs in HTML.
META_DIV = r'(?s)<div class="metadata">\n(.*?)\n</div>'
META_JOIN = "&nbsp;&nbsp;•&nbsp;&nbsp;"
#: Elements whose lines are no paragraphs.
BLOCK_TAGS = "h[1-6]|hr|li|ul|ol|p|div|pre|blockquote|table|thead|tbody|tr|td|th|section|article|figure"


def _meta_pairs(text: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(text, sep), strip), lambda p: p != "")


def metadata_html(text: Column | str) -> Column:
    """The inside of a metadata div: labelled pairs joined by spaced dots, between rules."""
    t = as_col(text)
    tabbed = _meta_pairs(t, "\t")
    pairs = F.when(F.size(tabbed) > 0, tabbed).otherwise(_meta_pairs(t, "•"))

    def item(pair: Column) -> Column:
        label = strip(F.replace(F.substring_index(pair, ":", 1), F.lit("**"), F.lit("")))
        rest = F.substring(pair, F.instr(pair, ":") + 1, F.char_length(pair))
        value = strip(F.replace(rest, F.lit("**"), F.lit("")))
        return F.concat(F.lit("<strong>"), label, F.lit(":</strong> "), value)

    items = F.transform(F.filter(pairs, lambda p: F.contains(p, F.lit(":"))), item)
    return F.concat(
        F.lit('<hr/>\n<div class="metadata">'), F.array_join(items, META_JOIN), F.lit("</div>\n<hr/>")
    )


def metadata_divs(text: Column | str) -> Column:
    """Rewrite every metadata div of a text."""
    t = as_col(text)
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(META_DIV), F.lit(1)))
    return F.aggregate(
        found, t,
        lambda acc, m: F.replace(
            acc, F.concat(F.lit('<div class="metadata">\n'), m, F.lit("\n</div>")), metadata_html(m)
        ),
    )


def handles(text: Column | str) -> Column:
    """``Name (@h)[date]``: name in strong, handle and date in spans; the date is optional."""
    who = rf"({WORD}+){WS}+\(@({WORD}+)\)"
    name = '<strong>$1</strong> <span class="twitter-handle">@$2</span>'
    t = F.regexp_replace(as_col(text), who + r"\[([^\]\n]+)\]", name + ' <span class="tweet-date">$3</span>')
    return F.regexp_replace(t, who + r"(?:\[\])?", name)


def images(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), r"(?d)!\[(.*?)\]\((.*?)\)", '<img src="$2" alt="$1">')


def links(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), r"(?d)\[(.*?)\]\((.*?)\)", '<a href="$2">$1</a>')


def footnotes(text: Column | str) -> Column:
    return F.regexp_replace(
        as_col(text), r"\[(\d+)\](?:\(#fn\d+-\d+\))?", '<sup><a href="#footnote-$1">$1</a></sup>'
    )


def bold(text: Column | str) -> Column:
    """``**x**`` outside tags."""
    return F.regexp_replace(as_col(text), r"\*\*([^*<]+)\*\*(?![^<]*>)", "<strong>$1</strong>")


def to_html(text: Column | str) -> Column:
    """All rewrites in order: metadata, handles, images before links, footnotes, bold, clean-up."""
    t = footnotes(links(images(handles(metadata_divs(text)))))
    return links(images(bold(t)))


def block_elements(text: Column | str) -> Column:
    """Headings, rules and list items as elements, other bare lines as paragraphs; lines that open or close a block stay.

    Lines are judged one by one, as a digest's rows are: list items get no list around them.
    """
    t = as_col(text)
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?dm)^#{{{level}}} +(.*)$", f"<h{level}>$1</h{level}>")
    t = F.regexp_replace(t, r"(?dm)^-{3,}$", "<hr>")
    t = F.regexp_replace(t, r"(?dm)^ *- +(.*)$", "<li>$1</li>")
    return F.regexp_replace(t, rf"(?dm)^(?! *</?(?:{BLOCK_TAGS})\b)(.*\S.*)$", "<p>$1</p>")


def simple_markdown(text: Column | str) -> Column:
    """Fallback converter: headings (longest first), bold, emphasis, links, list items."""
    t = as_col(text)
    for level in (3, 2, 1):
        t = F.regexp_replace(t, rf"(?d){'#' * level} (.*?)\n", f"<h{level}>$1</h{level}>\n")
    t = F.regexp_replace(t, r"(?d)\*\*(.*?)\*\*", "<strong>$1</strong>")
    t = F.regexp_replace(t, r"(?d)\*(.*?)\*", "<em>$1</em>")
    t = links(t)
    return F.regexp_replace(t, r"(?dm)^- (.*?)$", "<li>$1</li>")
