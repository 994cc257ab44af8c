"""Connected components of links by repeated contraction, on Spark tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component) for every linked node; component is the least node of its component.

    Each round sends every node to its least neighbour (or itself) and contracts the links; rounds are logarithmic in the
    nodes. Every round's tables are written, so that no plan grows with the rounds. No links give an empty table.
    """
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links, "links")
    found = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("component"))
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("component"), F.col("a").alias("to")).union(links.select("b", "a"))
        parent = written(ends.groupBy("component").agg(F.min("to").alias("to")), "parents")
        found = written(
            found.join(parent, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels"
        )
        step = lambda df, c: df.join(parent.select(F.col("component").alias(c), "to"), c).drop(c).withColumnRenamed("to", c)
        moved = step(step(links, "a"), "b").filter("a <> b")
        links = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return found
