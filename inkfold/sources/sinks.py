"""Digest sinks: ordered text, partitioned by issue and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.markup import block_elements, to_html
from inkfold.schemas import DIGEST_ORDER

HTML_HEAD = "<!DOCTYPE html>\n<html>\n<body>"
HTML_TAIL = "</body>\n</html>"
HEAD_PART, TAIL_PART = -1, 1_000


def document_order(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partition and sort; files written from it, read by name, give each document in order.

    A document may span any number of partitions, so no task has to hold one.
    """
    ranged = (
        lines.repartitionByRange(partitions, *DIGEST_ORDER) if partitions
        else lines.repartitionByRange(*DIGEST_ORDER)
    )
    return ranged.sortWithinPartitions(*DIGEST_ORDER)


def html_lines(lines: DataFrame) -> DataFrame:
    """The same document as HTML rows, between the opening and closing lines of a page."""
    names = [*DIGEST_ORDER]
    ids = lines.select("issue", "kind").distinct()

    def frame(part: int, text: str) -> DataFrame:
        blank: dict[str, Column] = {n: F.lit(0).cast("bigint") for n in names}
        blank.update(issue=F.col("issue"), kind=F.col("kind"), section=F.lit(""), subsection=F.lit(""),
                     part=F.lit(part).cast("bigint"), feed_ord=F.lit(-1).cast("bigint"), entry_ord=F.lit(-1).cast("bigint"))
        return ids.select(*[blank[n].alias(n) for n in names], F.lit(text).alias("line"))

    body = lines.select(*names, block_elements(to_html("line")).alias("line"))
    return frame(HEAD_PART, HTML_HEAD).unionByName(body).unionByName(frame(TAIL_PART, HTML_TAIL))


def conversion_status(lines: DataFrame) -> DataFrame:
    """Rows converted per document: the success map of a conversion run."""
    html = lines.select("issue", "kind", to_html("line").alias("html"))
    return html.groupBy("issue", "kind").agg(
        F.count("*").alias("rows"), (F.count_if(F.col("html").isNull()) == 0).alias("converted")
    )


def write_lines(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write documents as text under ``issue=.../kind=...``."""
    document_order(lines, partitions).select("issue", "kind", "line").write.mode("overwrite").partitionBy(
        "issue", "kind"
    ).text(path)


def write_digest_md(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    write_lines(lines, path, partitions)


def write_digest_html(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    write_lines(html_lines(lines), path, partitions)
