"""Connected components by contraction: every round hooks nodes to their smallest neighbour, flattens the
resulting forest by pointer jumping and maps the links onto its roots. Only DataFrame operations; each round is a
table in the shared folder, so neither links nor components ever reach the driver and lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _flat(forest: DataFrame) -> DataFrame:
    """(node, parent) with parent < node, to (node, root)."""
    forest = written(forest.select("node", "parent"), "cc-forest")
    while True:
        a, b, c = forest.alias("a"), forest.alias("b"), forest.alias("c")
        jumped = (
            a.join(b, F.col("a.parent") == F.col("b.node"), "left")
            .join(c, F.col("b.parent") == F.col("c.node"), "left")
            .select(
                F.col("a.node"),
                F.coalesce("c.parent", "b.parent", "a.parent").alias("parent"),
                F.col("b.parent").isNotNull().alias("moved"),
            )
        )
        after = written(jumped, "cc-jump")
        moved = after.agg(F.max("moved")).first()[0]
        drop_written(forest)
        forest = after.drop("moved")
        if not moved:
            return forest


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links, component being the smallest node reachable.

    Loops, repeated links and links with a null end are ignored; nodes without a link to another do not appear.
    No links give an empty result. Works for any ordered column type.
    """
    links = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col(a).isNull() | F.col(b).isNull()).alias("n"))
    links = written(links.where("not n and a < b").select("a", "b").distinct(), "cc-links")
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while not links.isEmpty():
        roots = _flat(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        labels = (
            labels.alias("l")
            .join(roots.alias("r"), F.col("l.component") == F.col("r.node"), "left")
            .select("l.node", F.coalesce("r.parent", "l.component").alias("component"))
        )
        labels = written(labels, "cc-labels")
        x, y = roots.alias("x"), roots.alias("y")
        mapped = (
            links.alias("e")
            .join(x, F.col("e.a") == F.col("x.node"), "left")
            .join(y, F.col("e.b") == F.col("y.node"), "left")
            .select(F.coalesce("x.parent", "e.a").alias("p"), F.coalesce("y.parent", "e.b").alias("q"))
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .where("a < b")
            .distinct()
        )
        links = written(mapped, "cc-links")
    return labels
