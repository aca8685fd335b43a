"""Connected components of a graph of links, in rounds of joins (large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdiff.llm.common import discard, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link to another; the component is its smallest node.

    Each round points every neighbour of a node to the smallest one, first the larger neighbours, then the smaller ones, until
    nothing changes. A node with very many links costs nothing special: its smallest neighbour is a partial aggregate, and
    the join that brings it back reads two written tables, which Spark can split. Rounds grow with the logarithm of the longest chain.
    Links with a null end and links of a node to itself do not count.
    """
    edges = stored(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(),
        "links",
    )
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if state == seen:
            break
        seen = state
        both = edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(edges.select("lo", "hi"))
        least = stored(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "links")
        large = both.join(least, "x").filter(F.col("y") > F.col("x")).select(F.col("y").alias("hi"), F.col("m").alias("lo"))
        large = stored(large.distinct(), "links")
        down = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "links")
        small = large.join(down, "hi").filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges, last = stored(small.union(down.select("hi", F.col("m").alias("lo"))).distinct(), "links"), edges
        discard(last, least, large, down)
    roots = edges.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
