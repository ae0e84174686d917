"""Connected components of a graph that may be as large as the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlink.llm.common import written


def _jumped(parents: DataFrame) -> DataFrame:
    """Let every vertex point to the root of its tree: pointers double until they stay."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
        step = written(
            parents.join(up, "parent", "left").select(
                "node",
                F.coalesce("_next", "parent").alias("parent"),
                (F.coalesce("_next", "parent") != F.col("parent")).alias("_moved"),
            ),
            "pointers",
        )
        parents = step.select("node", "parent")
        if not step.where("_moved").limit(1).count():
            return parents


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is connected with) of all linked nodes.

    ``links`` has ``a`` and ``b``. Every node hooks onto its smallest neighbour, pointers
    are doubled up to the roots, links are redrawn between roots, and so on until none is
    left. Each round at least halves the roots that still have links. What a hot node
    gathers is a minimum, summed up before the shuffle.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    roots: DataFrame | None = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("node"), F.min("b")).alias("parent")
        )
        parents = _jumped(written(parents, "parents"))
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            up = parents.select(F.col("node").alias("root"), "parent")
            moved = roots.join(up, "root", "left")
            roots = written(moved.select("node", F.coalesce("parent", "root").alias("root")), "roots")
        of_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        of_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        redrawn = edges.join(of_a, "a").join(of_b, "b").where("_a <> _b")
        edges = written(redrawn.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "links")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
