"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import Scratch, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round turns every node's links towards the smallest node it sees (large
    star, then small star) and stops when nothing changes; the rounds grow with
    the logarithm of the longest chain. The smallest neighbours, one row per node from partial
    aggregates, are written before the links are joined with them, so adaptive execution can split the
    links of a node that has a large share of all. Tables of the rounds are in the shared folder and go at
    the end; the result stays there. Self-links and repeated links don't matter.
    """
    with Scratch(edges.sparkSession) as scratch:
        now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        now, before = scratch.keep(now, "edges"), None
        while True:
            mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
            if mark == before:
                break
            before = mark
            both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
            # both directions of a link lie in `now`, so links to greater nodes are those of the lesser end
            large = scratch.keep(now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
            least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            turned = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = scratch.keep(turned.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        least = now.groupBy("u").agg(F.min("v").alias("component"))
        heads = least.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
        return materialise(least.select(F.col("u").alias("node"), "component").unionAll(heads), "components")
