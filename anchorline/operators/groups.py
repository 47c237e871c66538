"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.session import materialize


def connected_components(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str, rounds: int = 50) -> DataFrame:
    """Component of each node: `node`, component (the smallest node in it).

    Large-star and small-star steps alternate until nothing changes; each step writes its edges, whose number does
    not grow. A node with very many neighbours is combined before the shuffle (minimum per node). Null ends are no edges.
    """
    flat = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges"
    )
    for _ in range(rounds):
        both = flat.select("u", "v").union(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: larger neighbours of a node go to its smallest one.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large-star")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = materialize(small, "small-star")
        if small.count() == flat.count() and small.exceptAll(flat).isEmpty():
            break
        flat = small
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    lead = flat.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(lead.withColumnRenamed("u", node), node, "left").select(node, F.coalesce("component", node).alias("component"))
