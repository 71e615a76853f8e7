"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.storage import bounded, materialize


def _follow(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replace a node by its parent, where it has one."""
    p = bounded(parents).select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
    return (
        rows.join(p, F.col(column) == F.col("__n"), "left")
        .withColumn(column, F.coalesce("__p", column))
        .drop("__n", "__p")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node.

    Each round every node hooks to its smallest neighbour if that is smaller, two
    jumps shorten the chains, and the edges are contracted. Duplicate edges,
    loops and both directions may occur; no edges give no rows.
    """
    edges = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
    )
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("component")), "labels")
    while edges.limit(1).count():
        # An edge (a, b) has a < b, so only b can hook, and no cycle arises.
        parents = materialize(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents")
        for _ in range(2):
            parents = materialize(_follow(parents, "parent", parents), "parents")
        labels = materialize(_follow(labels, "component", parents), "labels")
        moved = _follow(_follow(edges, "a", parents), "b", parents)
        edges = materialize(
            moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
        )
    return labels
