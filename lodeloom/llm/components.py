"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeloom.llm.common import held


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """node, class_id (the least node of its component) for every node of links(a, b); a and b are longs.

    Each round every node points to the neighbour that comes first in an order by hash, another order each round, links
    are redrawn between what their ends point to, and loops and copies go. A constant share of the nodes goes each round,
    whatever the shape. Links, pointers and labels are tables in the shared folder; only whether any link is left reaches
    the driver. A much-linked node is met by partial aggregates and by joins that can be split.
    """
    edges = held(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    first, hops = edges, []
    while not edges.isEmpty():
        turn = F.lit(len(hops))
        rank = lambda c: F.struct(F.xxhash64(c, turn).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        ends = edges.select(F.col("a").alias("u"), rank("b").alias("to")).union(edges.select(F.col("b").alias("u"), rank("a").alias("to")))
        nearest = ends.groupBy("u").agg(F.min("to").alias("to"))
        hop = held(nearest.select("u", F.least(F.struct(F.xxhash64("u", turn).alias("h"), F.col("u").alias("node")), F.col("to"))["node"].alias("parent")), f"{name}-hop")
        hops.append(hop)
        moved = edges.join(hop.select(F.col("u").alias("a"), F.col("parent").alias("pa")), "a").join(hop.select(F.col("u").alias("b"), F.col("parent").alias("pb")), "b")
        edges = held(moved.where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), f"{name}-edges")
    label = first.select(F.col("a").alias("node")).union(first.select("b")).distinct().withColumn("label", F.col("node"))
    for hop in hops:
        label = label.join(hop.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
    label = held(label, f"{name}-labels")
    least = held(label.groupBy("label").agg(F.min("node").alias("class_id")), f"{name}-least")
    return label.join(least, "label").select("node", "class_id")
