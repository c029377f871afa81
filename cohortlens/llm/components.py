"""Connected components of an edge list by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import staged


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; the component is its smallest node.

    Each round hangs every node below its smallest neighbour, follows these
    links to their end, and contracts the edges to the ends. All steps are
    joins and minima by key, which reduce before the shuffle, so a node with
    very many edges is never gathered in one task. What a round leaves is
    written to the shared folder, so lost executors cost one round at most.
    Loops and repeated edges do no harm; an edge with a null end is left out;
    no edges give no rows.
    """
    ends = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
    live = staged(
        ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    nodes = ends.filter("a IS NOT NULL AND b IS NOT NULL").select(F.explode(F.array("a", "b")).alias("node"))
    rounds = []
    while not live.isEmpty():
        parents = staged(live.groupBy("a").agg(F.min("b").alias("up")), "parents")
        while True:
            above = parents.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jumped = staged(
                parents.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")),
                "parents",
            )
            parents = jumped.select("a", "up")
            if jumped.filter("moved").isEmpty():
                break
        rounds.append(parents)
        one = live.join(parents, "a", "left").select(F.coalesce("up", "a").alias("a"), "b")
        two = one.join(parents.select(F.col("a").alias("b"), "up"), "b", "left").select("a", F.coalesce("up", "b").alias("b"))
        live = staged(
            two.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
            "edges",
        )
    labels = nodes.distinct().select("node", F.col("node").alias("component"))
    for parents in rounds:
        labels = labels.join(parents.select(F.col("a").alias("component"), "up"), "component", "left").select(
            "node", F.coalesce("up", "component").alias("component")
        )
    return staged(labels, "labels")
