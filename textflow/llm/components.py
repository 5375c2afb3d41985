"""Connected components of an edge table, by DataFrame operations only.

Every node hooks to its smallest neighbour, the hooks are shortened to their
roots by pointer jumping, and the edges are carried over to the roots, until
no edge is left. Each round at least halves the nodes of a component, hubs
need no neighbour list (a minimum combines on the map side), and every
intermediate table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop


def _replaced(table: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``column`` taken to its root; a node without a hook is its own."""
    to = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return (table.join(to, table[column] == to["_node"], "left")
            .withColumn(column, F.coalesce("_root", column)).drop("_node", "_root"))


def _roots(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes that hook to a smaller one; roots are
    nodes that don't. ``edges`` has ``a > b`` in every row."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = cut(both.groupBy("a").agg(F.min("b").alias("root")).where("root < a").withColumnRenamed("a", "node"))
    while True:
        shorter = cut(_replaced(hooks.withColumn("old", F.col("root")), "root", hooks))
        drop(hooks)
        hooks = shorter.drop("old")
        if shorter.where("root <> old").isEmpty():
            return hooks


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge: ``root`` is the smallest
    node of its component. Edges may repeat, run either way or be loops (a
    node with loops only is its own root); rows with a null end are left out.
    No edges give an empty table."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    ordered = lambda t: t.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ends = cut(ends.distinct())
    members = cut(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    left = cut(ordered(ends))
    while not left.isEmpty():
        hooks = _roots(left)
        carried = cut(_replaced(members, "root", hooks))
        rest = cut(ordered(_replaced(_replaced(left, "a", hooks), "b", hooks)))
        for old in (members, left, hooks):
            drop(old)
        members, left = carried, rest
    drop(ends)
    return members
