"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contaflux.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 50) -> DataFrame:
    """(node, comp) of every node in links (a, b): comp is the smallest node of its component.

    Each round every node is linked to the smallest of its neighbours and itself: first the
    larger neighbours (large star), then the smaller (small star). Rounds end when the links
    no longer change; their number grows with the logarithm of a component's size, and more
    than most_rounds of them raise RuntimeError. Nodes without a link, and links of a node with itself, give no row.
    """
    edges = links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct()
    edges = scratch.keep(edges)
    before = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of a node goes to the node's least neighbour.
        both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        # Small star: every smaller neighbour of a node, and the node, go to the least of them.
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(least, "x")
        small = joined.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y"))).distinct()
        after = scratch.keep(small)
        count = after.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)")), F.sum(F.xxhash64("y", "x").cast("decimal(20,0)"))).first()
        scratch.drop(edges)
        edges = after
        if count == before:
            break
        before = count
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return edges.groupBy("x").agg(F.min("y").alias("comp")).select(F.col("x").alias("node"), "comp").unionByName(
        edges.select(F.col("y").alias("node"), F.col("y").alias("comp")).distinct()
    ).groupBy("node").agg(F.min("comp").alias("comp"))
