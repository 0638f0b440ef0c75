"""Running totals and positions inside groups of any size.

A window over a whole group would bring a category with a third of all rows to one task. Here the
group is cut into blocks of consecutive order keys; totals per block are aggregated (with map-side
combine), summed up over blocks in two levels, and only then added to a running sum inside a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000
BLOCK_FEEDS = 10_000


def running_total(
    df: DataFrame, keys: list[str], value: Column, name: str, order: tuple[str, str],
    block_rows: int = BLOCK_ROWS, block_feeds: int = BLOCK_FEEDS, attach: DataFrame | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over the group's rows up to this one.

    ``order`` is (major, minor), two whole-number columns, unique together inside a group and reasonably
    dense, as feed and entry positions are; neither they nor ``keys`` may be null. ``attach`` holds one row per group; its columns come along with the block totals, so
    that the article rows are not shuffled once more for them.
    """
    major, minor = order
    block = ["_major_block", major, "_minor_block"]
    d = df.withColumns(
        {
            "_major_block": F.expr(f"`{major}` div {int(block_feeds)}"),
            "_minor_block": F.expr(f"`{minor}` div {int(block_rows)}"),
            "_value": value.cast("bigint"),
        }
    )
    totals = d.groupBy(*keys, *block).agg(F.sum("_value").alias("_block_total"))
    before = (Window.unboundedPreceding, -1)
    coarse = totals.groupBy(*keys, "_major_block").agg(F.sum("_block_total").alias("_coarse_total"))
    coarse = coarse.select(
        *keys, "_major_block",
        F.coalesce(
            F.sum("_coarse_total").over(Window.partitionBy(*keys).orderBy("_major_block").rowsBetween(*before)),
            F.lit(0),
        ).alias("_coarse_before"),
    )
    fine = totals.withColumn(
        "_fine_before",
        F.coalesce(
            F.sum("_block_total").over(
                Window.partitionBy(*keys, "_major_block").orderBy(major, "_minor_block").rowsBetween(*before)
            ),
            F.lit(0),
        ),
    )
    offsets = fine.join(coarse, [*keys, "_major_block"]).select(
        *keys, *block, (F.col("_fine_before") + F.col("_coarse_before")).alias("_before")
    )
    added = [name]
    if attach is not None:
        offsets = offsets.join(attach, keys)
        added += [c for c in attach.columns if c not in keys]
    inside = Window.partitionBy(*keys, *block).orderBy(minor).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_inside", F.sum("_value").over(inside))
    return d.join(offsets, [*keys, *block]).withColumn(
        name, F.col("_before") + F.col("_inside")
    ).select(*df.columns, *added)


def position(df: DataFrame, keys: list[str], name: str, order: tuple[str, str], **options) -> DataFrame:
    """Add the 1-based position of a row inside its group."""
    return running_total(df, keys, F.lit(1), name, order, **options)
