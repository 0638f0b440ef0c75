"""Classification by rule tables of any size.

The rules of ``classify`` are literals of the plan, which suits some hundreds of keywords. Here the keywords stay a table:
it is read in blocks of a bounded number of keywords, each task builds one Aho-Corasick automaton of a block, and the
automaton reads every text once, whatever the number of keywords. Only the text goes to Python, in Arrow batches; the
plan is the same for ten keywords and for a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.text import blank_if_null, weighted_text

#: Keywords of one automaton; a larger table takes as many passes over the text, in the same tasks.
BLOCK_KEYWORDS = 200_000
SCORES = "array<struct<ord:int,category:string,score:bigint>>"


def rule_blocks(rules: DataFrame, size: int = BLOCK_KEYWORDS) -> Iterator[list[tuple]]:
    """(keyword in lower case, order, category) of a rule table (category, rule_ord, keyword), in blocks; the driver holds
    one. A rule that is there twice counts twice; empty keywords count nothing."""
    rows = rules.select(F.lower("keyword").alias("keyword"), F.col("rule_ord").cast("int").alias("ord"), "category")
    block: list[tuple] = []
    for r in rows.filter(F.coalesce(F.col("keyword"), F.lit("")) != "").orderBy("ord", "keyword").toLocalIterator():
        block.append((r["keyword"], r["ord"], r["category"]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def automaton(block: list[tuple]):
    """The automaton of a block; a keyword's value is its length and the categories it counts for."""
    import ahocorasick

    owners: dict[str, list] = {}
    for keyword, order, category in block:
        owners.setdefault(keyword, []).append((order, category))
    out = ahocorasick.Automaton()
    for i, (keyword, categories) in enumerate(owners.items()):
        out.add_word(keyword, (i, len(keyword), categories))
    out.make_automaton()
    return out


def text_scores(text: str, found) -> list[dict]:
    """Occurrences per category. An occurrence that overlaps the one before it of the same keyword does not count."""
    free_from: dict[int, int] = {}
    score: dict[tuple, int] = {}
    for last, (i, length, categories) in found.iter(text):
        if last - length + 1 >= free_from.get(i, 0):
            free_from[i] = last + 1
            for c in categories:
                score[c] = score.get(c, 0) + 1
    return [{"ord": o, "category": c, "score": n} for (o, c), n in sorted(score.items(), key=lambda x: x[0][0])]


def _scores_of(block_sent) -> Column:
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = automaton(block_sent.value)
        for texts in batches:
            yield pd.Series([text_scores(t, found) if t else [] for t in texts], dtype=object)

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scores, SCORES)


def keyword_scores(df: DataFrame, rules: DataFrame, text: Column, name: str = "scores",
                   block_keywords: int = BLOCK_KEYWORDS) -> DataFrame:
    """Add the scores of the categories that ``text`` (compared in lower case) holds keywords of, in declared order."""
    out = df.withColumn("_rule_text", F.lower(text))
    parts = []
    for block in rule_blocks(rules, block_keywords):
        sent = df.sparkSession.sparkContext.broadcast(block)  # at most block_keywords rows of the rule table
        parts.append(f"_scores_{len(parts)}")
        out = out.withColumn(parts[-1], _scores_of(sent)("_rule_text"))
    if not parts:
        merged = F.array().cast(SCORES)
    elif len(parts) == 1:
        merged = F.col(parts[0])
    else:
        # a category whose keywords lie in several blocks is one
        every = F.concat(*parts)
        first = F.array_sort(F.array_distinct(F.transform(every, lambda s: F.struct(s["ord"].alias("ord"), s["category"].alias("category")))))
        merged = F.transform(first, lambda c: F.struct(
            c["ord"].alias("ord"), c["category"].alias("category"), F.aggregate(
                F.filter(every, lambda s: (s["ord"] == c["ord"]) & s["category"].eqNullSafe(c["category"])),
                F.lit(0).cast("bigint"), lambda n, s: n + s["score"]).alias("score")))
    return out.withColumn(name, merged).drop("_rule_text", *parts)


def classify_by_table(df: DataFrame, rules: DataFrame, text: Column | str = "full_text", title: Column | str = "title",
                      block_keywords: int = BLOCK_KEYWORDS) -> DataFrame:
    """Add category, category_score (share of the total) and scores (of the categories that occur), by a rule table.

    The same result as ``classify`` without source boosts, for tables that are too large for it. The best score wins, ties
    the first declared; without any keyword the category is ``Other``.
    """
    scored = keyword_scores(df, rules, weighted_text(title, text), "scores", block_keywords)
    best = F.array_max(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["ord"]).alias("ord"),
                                                                s["category"].alias("category"))))
    empty = (blank_if_null(text) == "") & (blank_if_null(title) == "")
    total = F.aggregate("scores", F.lit(0).cast("bigint"), lambda n, s: n + s["score"])
    held = ~empty & (F.size("scores") > 0)
    return scored.withColumns({
        "category": F.when(held, best["category"]).otherwise("Other"),
        "category_score": F.when(held, best["score"] / total).otherwise(F.lit(0.0))})
