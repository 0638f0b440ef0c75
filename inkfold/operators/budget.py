"""Word budgets: keep whole paragraphs while they fit, cut the first that does not, stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.text import as_col, let, strip, word_count, words
from inkfold.functions.tree import truncate_words_udf
from inkfold.operators.numbering import running_total


def first_words(text: Column | str, n: Column) -> Column:
    """The first ``n`` words and an ellipsis."""
    return F.concat(F.array_join(F.slice(words(text), F.lit(1), n.cast("int")), " "), F.lit("..."))


def word_budget(
    df: DataFrame, key: str, pos: str, paragraph: str, limit: int, cut: Column | None = None,
) -> DataFrame:
    """Paragraph rows ``(key, pos, paragraph)`` that fit in ``limit`` words per key, the last one cut.

    ``cut`` tells which rows may be cut at all; a row that may not is dropped where it would cross.
    The running total is built block-wise, so one key may hold any number of rows.
    """
    filled = df.withColumn(paragraph, strip(paragraph)).filter(F.col(paragraph) != "")
    filled = filled.withColumns({"_words": word_count(paragraph), "_one": F.lit(0)})
    run = running_total(filled, [key], F.col("_words"), "_run", ("_one", pos))
    before = F.col("_run") - F.col("_words")
    room = F.lit(limit) - before
    kept = run.filter(room > 0)
    if cut is not None:
        kept = kept.filter((F.col("_run") <= limit) | cut)
    return kept.withColumn(
        paragraph,
        F.when(F.col("_run") <= limit, F.col(paragraph)).otherwise(first_words(paragraph, room)),
    ).select(*df.columns)


def budget_paragraphs(paragraphs: Column | str, limit: int) -> Column:
    """The same rule inside one row: array of paragraphs in, array of kept paragraphs out.

    Only the number of words is carried from paragraph to paragraph; which stay, and which one is cut, follows from the
    place where it reaches the limit.
    """
    def kept(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("run"), F.lit(False).alias("full"))
        # the paragraphs that fit whole, their words, and whether the limit has been met
        end = F.aggregate(p, start, lambda acc, x: F.when(acc["full"], acc).otherwise(let(
            acc["run"] + word_count(x), lambda run: F.when(run <= limit, F.struct(
                (acc["n"] + 1).alias("n"), run.alias("run"), (run == limit).alias("full"))).otherwise(F.struct(
                    acc["n"].alias("n"), acc["run"].alias("run"), F.lit(True).alias("full"))))))

        def cut(e: Column) -> Column:
            after = F.when(e["run"] < limit, F.transform(
                F.slice(p, e["n"] + 1, F.lit(1)), lambda x: first_words(x, F.lit(limit) - e["run"])))
            return F.concat(F.slice(p, F.lit(1), e["n"]), F.coalesce(after, F.array().cast("array<string>")))

        return let(end, cut)

    filled = F.filter(F.transform(as_col(paragraphs), strip), lambda p: p != "")
    return let(filled, kept)


def truncate_html_words(html: Column | str, limit: int) -> Column:
    """Text stops after ``limit`` words, tags before that point stay, open elements are closed.

    Which tag closes which is found by one walk over the tags, in time in proportion to the text, in the Arrow helper;
    a text without tags stays in the JVM.
    """
    text = as_col(html)
    plain = F.when(word_count(text) <= limit, text).otherwise(
        F.array_join(F.slice(words(text), F.lit(1), F.lit(limit)), " "))
    return F.coalesce(truncate_words_udf(F.when(F.contains(text, F.lit("<")), text), limit), plain)
