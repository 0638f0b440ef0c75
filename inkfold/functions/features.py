"""Article features and the paywall flag. Column -> Column."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.functions.patterns import presence_passes, trie_regex
from inkfold.functions.text import (
    as_col, blank_if_null, count_occurrences, domain_after_scheme, host, lead_of, let, reading_time,
    sentences, word_count,
)
from inkfold.rules import PAYWALL_DOMAINS, PAYWALL_TERMS, TECHNICAL_TERMS

# Signs of code in a text.
CODE_SIGNS = r"```|\{|\}|function|class|def|return|import"


def has_code(text: Column | str) -> Column:
    return F.coalesce(as_col(text).rlike(CODE_SIGNS), F.lit(False))


def quote_count(text: Column | str) -> Column:
    return count_occurrences(blank_if_null(text), '"')


def technical_terms(text: Column | str) -> Column:
    """How many of the technical terms occur at all."""
    low = F.lower(blank_if_null(text))
    hits = [F.contains(low, F.lit(t)).cast("bigint") for t in TECHNICAL_TERMS]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def on_paywall_domain(url: Column | str, mode: str = "host") -> Column:
    """Known paywalled site: host equal to or under it, or ``mode="substring"`` anywhere in the authority."""
    sites = trie_regex(PAYWALL_DOMAINS)
    if mode == "substring":
        hit = domain_after_scheme(url).rlike(sites)
    else:
        hit = host(url).rlike(rf"(?:^|\.)(?:{sites})\z")
    return F.coalesce(hit, F.lit(False))


def paywall_flag(text: Column | str, url: Column | str, mode: str = "host") -> Column:
    """A paywall phrase in the text, or a known site with fewer than 1000 characters."""
    low = F.lower(blank_if_null(text))
    known = reduce(or_, [low.rlike(p) for p in presence_passes(PAYWALL_TERMS)])
    return known | (on_paywall_domain(url, mode) & (F.char_length(low) < 1000))


def article_features(
    text: Column | str, html: Column | str, url: Column | str, images: Column | None = None,
    mode: str = "host",
) -> Column:
    """The features struct of one article; ``html`` is the raw page the links are counted in."""
    t = blank_if_null(text)
    n_words = word_count(t)
    # Sentences are cut once for both of their uses.
    prose = let(
        sentences(t),
        lambda s: F.struct(F.size(s).cast("bigint").alias("n"), lead_of(s, t).alias("summary")),
    )
    quotes = quote_count(t)
    if images is None:
        images = F.array().cast("array<struct<src:string,alt:string,width:string,height:string>>")
    return F.struct(
        F.char_length(t).cast("bigint").alias("length"),
        n_words.alias("word_count"),
        has_code(t).alias("has_code"),
        (quotes * 3).alias("has_quotes"),
        quotes.alias("quote_count"),
        prose["n"].alias("sentence_count"),
        count_occurrences(blank_if_null(html), "href=").alias("link_count"),
        reading_time(n_words).alias("reading_time"),
        technical_terms(t).alias("technical_terms"),
        images.alias("images"),
        prose["summary"].alias("summary"),
        paywall_flag(t, url, mode).alias("paywall_detected"),
        F.lit(None).cast("string").alias("main_image"),
    )
