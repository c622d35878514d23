"""Connected components of an edge table, as joins and partially aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component's name is its smallest node.

    Every round hooks each node to its smallest neighbour (a minimum that is combined before the shuffle, so a node of very
    many edges costs no task more than others), follows the hooks to their roots by doubling, and contracts the edges to the
    roots. At least every second node that still has edges goes in each round. Rows with a null end and loops are ignored;
    repeated edges count once; without edges the result is empty.
    """
    pairs = edges.filter(F.col("a") != F.col("b"))
    left = stage(_distinct(pairs.select("a", "b")), "edges")
    names = None
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
        hooks = _roots(stage(hooks, "hooks"))
        if names is None:
            names = hooks
        else:
            further = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            names = stage(names.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "names")
        a = hooks.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        b = hooks.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        between = left.join(a, "a").join(b, "b").filter(F.col("root_a") != F.col("root_b"))
        left = stage(_distinct(between.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "edges")
    if names is None:
        names = left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names.select("node", F.col("root").alias("component"))


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(hooks: DataFrame) -> DataFrame:
    """Hooks always lead to smaller nodes, so following them ends; each step doubles the distance that is covered."""
    while True:
        above = hooks.filter(F.col("node") != F.col("root")).select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = stage(hooks.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"),
                                                               F.col("above").isNotNull().alias("moved")), "roots")
        hooks = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return hooks
