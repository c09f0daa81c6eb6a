"""Connected components of a link table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns a, b (long). Returns (node, component): the smallest id reachable from each linked node.

    Each round maps every node to its smallest neighbour (or itself), and contracts the links by that map, keeping the map's own
    steps as links; at least half of the nodes with links go each round. Minima combine before the shuffle and the joins are
    plain equi joins that AQE can split, so one node with very many links is no hot spot. Empty links give no rows; self links,
    repeated links and null ends are allowed and ignored.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    links = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    label = None
    while not links.isEmpty():
        step = saved(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to")), "cc-step")
        left, right = step.toDF("a", "a_to"), step.toDF("b", "b_to")
        moved = links.join(left, "a").join(right, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        climb = step.where("node <> to").join(left, F.col("to") == F.col("a")).select(F.col("to").alias("a"), F.col("a_to").alias("b"))
        ends = moved.unionByName(climb).where("a <> b")
        links = saved(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
        if label is None:
            label = step.select("node", F.col("to").alias("component"))
        else:
            label = saved(label.join(step.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "cc-label")
    return label if label is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
