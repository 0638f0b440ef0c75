"""Word frequency and top keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.text import extract_words, let


def word_counts(text: Column | str) -> Column:
    """Array of (word, n, first_pos) of one text, by word.

    Sorting (word, position) pairs inside the row and measuring the runs needs no shuffle, whereas
    exploding would send every word of every text over the network.
    """
    pairs = F.array_sort(
        F.transform(extract_words(text), lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    )

    def starts(p: Column) -> Column:
        marked = F.transform(
            p,
            lambda x, i: F.when(
                (i == 0) | (x["word"] != F.get(p, F.greatest(i - 1, F.lit(0)))["word"]), i
            ),
        )
        return F.filter(marked, lambda i: i.isNotNull())

    def runs(p: Column, s: Column) -> Column:
        return F.transform(
            s,
            lambda i, k: F.struct(
                F.get(p, i)["word"].alias("word"),
                (F.coalesce(F.get(s, k + 1), F.size(p)) - i).cast("bigint").alias("n"),
                F.get(p, i)["pos"].cast("bigint").alias("first_pos"),
            ),
        )

    return let(pairs, lambda p: let(starts(p), lambda s: runs(p, s)))


def with_word_counts(df: DataFrame, text: str, name: str = "word_counts") -> DataFrame:
    return df.withColumn(name, word_counts(text))


def word_frequency(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, word, n)."""
    # The outer form: the inner one would add a size filter that counts the words a second time.
    return with_word_counts(df.select(key, text), text).select(
        key, F.inline_outer("word_counts")
    ).filter(F.col("word").isNotNull()).drop("first_pos")


def top_keywords(df: DataFrame, text: str, k: int = 5, name: str = "keywords") -> DataFrame:
    """Add the ``k`` most frequent words; equal counts keep the order of first use."""
    out = with_word_counts(df, text, "_counts")
    ranked = F.array_sort(
        F.transform("_counts", lambda c: F.struct((-c["n"]).alias("a"), c["first_pos"].alias("b"), c["word"].alias("word")))
    )
    return out.withColumn(name, F.transform(F.slice(ranked, 1, k), lambda c: c["word"])).drop("_counts")
