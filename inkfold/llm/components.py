"""Connected components of a graph of any size, by union-find steps as joins.

Labels are row keys. Every round hooks each root to the least root across a link, then halves the paths to the
roots. Links and labels are written to the shared folder every round; the driver sees only whether anything
changed. A node with very many links is aggregated before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) of every node of ``links`` (a, b: long): root is the least node it can reach."""
    return _components(_stored_links(links))


def _stored_links(links: DataFrame) -> DataFrame:
    return stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .distinct(), "links")


def _components(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        labels = _shortened(labels)
        # links between roots that still differ
        open_links = (links.join(labels.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
                      .join(labels.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
                      .where("x <> y").select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("node")))
        hooks = stored(open_links.groupBy("node").agg(F.min("low").alias("low")), "hooks")
        if hooks.isEmpty():
            return labels
        labels = stored(labels.join(hooks, "node", "left").select(
            "node", F.least("root", F.coalesce("low", "root")).alias("root")), "labels")


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The rows of ``components`` when ``links`` are added to the graph that ``labels`` describes.

    Only links between components that still differ are followed, so a later round costs what it adds; ``labels``
    themselves come back if there are none.
    """
    if labels is None:
        return components(links)
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    between = _stored_links(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    if between.isEmpty():
        return labels
    merged = _components(between)
    moved = labels.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
        "node", F.coalesce("top", "root").alias("root"))
    return stored(moved.unionByName(merged.join(labels, "node", "left_anti").select("node", "root")), "labels")


def _shortened(labels: DataFrame) -> DataFrame:
    """Point every node at its root's root until all roots are their own."""
    while True:
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        shorter = stored(labels.join(up, "root", "left").select(
            "node", F.coalesce("top", "root").alias("root"),
            (F.coalesce("top", "root") != F.col("root")).alias("moved")), "labels")
        labels = shorter.select("node", "root")
        if shorter.where("moved").isEmpty():
            return labels
