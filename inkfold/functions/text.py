"""Scalar text, URL and time functions: Column -> Column, all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.rules import STOP_WORDS

# Unicode white space as text splitting sees it, and word characters.
# Printable ASCII is told first, by one comparison.
WS = r"[\x00-\x20\x7f-\x{10ffff}&&[\s\x0b\x1c-\x1f\x85\p{Z}]]"
NON_WS = r"[!-~[^\s\x0b\x1c-\x1f\x85\p{Z}]]"
WORD = r"[a-z0-9_\p{L}\p{N}]"

# The sentence-split rule, a space after . ? ! unless it follows "x.y." or "Xx."
SENTENCE_BREAK = rf"(?<!{WORD}\.{WORD}[^\n])(?<![A-Z][a-z]\.)(?<=[.?!]){WS}"

# Signs of text split into characters, and of markup broken the same way.
SPACED_CHARS = rf"(?<!{WORD}){WORD} {WORD} {WORD} {WORD}(?!{WORD})"
SPLIT_LINES = rf"\n{WS}*{WORD}{WS}*\n{WS}*{WORD}{WS}*\n{WS}*{WORD}"
MALFORMED_HTML = r"<[a-zA-Z][^>]{0,1}>[^<]{0,1}<"

# The one date form that is parsed.
PUBLISHED_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_non_empty(*cols: Column | str) -> Column:
    """First value that is neither null nor the empty string, else null."""
    return F.coalesce(*[F.nullif(as_col(c), F.lit("")) for c in cols])


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def count_occurrences(text: Column | str, keyword: str) -> Column:
    """Non-overlapping occurrences of a literal substring. Byte lengths keep it to one pass."""
    if not keyword:
        raise ValueError("keyword must not be empty")
    t = as_col(text)
    removed = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(keyword), F.lit("")))
    return F.floor(removed / F.lit(len(keyword.encode("utf-8")))).cast("bigint")


def count_whole_word(text: Column | str, keyword: str) -> Column:
    """Occurrences of ``keyword`` that do not touch another word character."""
    pattern = rf"(?<!{WORD})\Q{keyword}\E(?!{WORD})"
    return F.regexp_count(as_col(text), F.lit(pattern)).cast("bigint")


def weighted_text(title: Column | str, body: Column | str) -> Column:
    """Lower-case text in which the title counts twice."""
    t, b = blank_if_null(title), blank_if_null(body)
    return F.lower(F.concat_ws(" ", t, t, b))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(NON_WS + "+"), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(as_col(text), F.lit(NON_WS + "+")), F.lit(0)).cast("bigint")


def has_words(text: Column | str, n: int) -> Column:
    """At least ``n`` words; reads no further than the ``n``-th."""
    return blank_if_null(text).rlike(rf"\A{WS}*+(?:{NON_WS}++{WS}++){{{n - 1}}}{NON_WS}")


def reading_time(word_total: Column | str) -> Column:
    """Whole minutes at 200 words a minute, at least one."""
    w = as_col(word_total)
    return F.greatest(F.lit(1), F.floor(w / 200)).cast("bigint")


def truncate_chars(text: Column | str, n: int = 500) -> Column:
    t = as_col(text)
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def truncate_words(text: Column | str, n: int) -> Column:
    """Text of more than ``n`` words becomes its first ``n`` words and an ellipsis."""
    t = as_col(text)
    return let(words(t), lambda w: F.when(
        F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))
    ).otherwise(t))


def strip(text: Column | str) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(as_col(text), rf"^{WS}+|{WS}+\z", "")


def normalize_ws(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(text), WS + "+", " "))


def sentences(text: Column | str) -> Column:
    """Array of trimmed, non-blank sentences."""
    parts = F.split(as_col(text), SENTENCE_BREAK)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentence_count(text: Column | str) -> Column:
    return F.coalesce(F.size(sentences(text)), F.lit(0)).cast("bigint")


def lead_of(parts: Column, text: Column) -> Column:
    """Summary of a text from its sentences."""
    lead = F.when(F.size(parts) <= 3, F.array_join(parts, " ")).otherwise(
        truncate_chars(F.array_join(F.slice(parts, 1, 3), " "), 500)
    )
    return blank_if_null(F.when(F.size(parts) > 0, lead).otherwise(truncate_chars(text, 500)))


def lead_summary(text: Column | str) -> Column:
    """At most three sentences as they are; from a longer text its first three, cut at 500 characters."""
    t = as_col(text)
    return let(sentences(t), lambda s: lead_of(s, t))


def extract_words(text: Column | str) -> Column:
    """Lower-case ASCII words of 3 to 15 letters, without stop words, in text order."""
    found = F.regexp_extract_all(
        F.lower(as_col(text)), F.lit(rf"(?<!{WORD})[a-zA-Z]{{3,15}}(?!{WORD})"), F.lit(0)
    )
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def token_estimate(text: Column | str) -> Column:
    """Approximate model tokens: words plus a quarter of the characters."""
    t = as_col(text)
    return word_count(t) + F.coalesce(F.floor(F.char_length(t) / 4), F.lit(0)).cast("bigint")


def slug(text: Column | str) -> Column:
    return F.replace(F.lower(as_col(text)), F.lit(" "), F.lit("-"))


def parse_published(text: Column | str) -> Column:
    return F.try_to_timestamp(as_col(text), F.lit(PUBLISHED_FORMAT))


def format_published(text: Column | str) -> Column:
    """``February 06, 2025`` for the one parseable form; anything else passes through."""
    t = as_col(text)
    return F.coalesce(F.date_format(parse_published(t), "MMMM dd, yyyy"), t)


def format_issue_date(issue: Column | str) -> Column:
    return F.date_format(as_col(issue).cast("date"), "MMMM dd, yyyy")


def domain(url: Column | str) -> Column:
    """URL authority, with user and port when given."""
    return F.regexp_extract(as_col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)


def domain_after_scheme(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), r"://([^/]*)", 1)


def host(url: Column | str) -> Column:
    """Lower-case host: the authority without user and port."""
    bare = F.regexp_replace(F.lower(domain(url)), r"^.*@", "")
    return F.regexp_replace(bare, r":\d*\z", "")


# --- repair of text that was split into single characters -------------------------------------


def strip_tags(text: Column | str) -> Column:
    """Replace every tag by a space and normalise white space."""
    return normalize_ws(F.regexp_replace(as_col(text), r"<[^>]*>", " "))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def has_single_char_lines(text: Column | str) -> Column:
    t = as_col(text)

    def mostly_single(filled: Column) -> Column:
        single = F.filter(filled, lambda x: F.char_length(x) <= 1)
        return (F.size(filled) > 5) & (F.size(single) / F.size(filled) > 0.6)

    filled_lines = F.filter(_lines(t), lambda x: x != "")
    # more than 20 characters from the first that is no white space to the last
    long_enough = t.rlike(rf"\A{WS}*+{NON_WS}(?s:.{{19,}}){NON_WS}")
    return F.contains(t, F.lit("\n")) & long_enough & let(filled_lines, mostly_single)


def has_spaced_chars(text: Column | str) -> Column:
    return as_col(text).rlike(SPACED_CHARS)


def has_split_lines(text: Column | str) -> Column:
    return as_col(text).rlike(SPLIT_LINES)


def is_malformed_html(text: Column | str) -> Column:
    return as_col(text).rlike(MALFORMED_HTML)


def join_lines(text: Column | str) -> Column:
    return F.array_join(_lines(as_col(text)), "")


def join_spaced_chars(text: Column | str) -> Column:
    t = F.regexp_replace(as_col(text), rf"({WORD}) ({WORD}) ({WORD})", "$1$2$3")
    for _ in range(2):
        t = F.regexp_replace(t, rf"({WORD}) ({WORD})", "$1$2")
    return t


def repair_kind(text: Column | str) -> Column:
    """Which split-character damage a text shows, first match wins; null when none."""
    t = as_col(text)
    return (
        F.when(has_single_char_lines(t), "single_char_lines")
        .when(has_spaced_chars(t), "spaced_chars")
        .when(has_split_lines(t), "split_lines")
    )


def repair_split_text(text: Column | str, kind: Column | str, limit: int = 500) -> Column:
    """Joined text in one ``<p>``, at most ``limit`` words; ``''`` if nothing is left, null if no damage."""
    t, k = as_col(text), as_col(kind)
    joined = F.when(k == "spaced_chars", join_spaced_chars(t)).when(k.isNotNull(), join_lines(t))
    clean = strip_tags(joined)
    return F.when(clean == "", F.lit("")).when(
        clean.isNotNull(), F.concat(F.lit("<p>"), truncate_words(clean, limit), F.lit("</p>"))
    )
