"""Connected components of a graph given as links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no neighbourhood is collected; each round is kept as a table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.stages import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b) that is not the smallest of its component."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, before, number = scratch.keep(edges, "star-0"), None, 0
    while True:
        # Edges are distinct, so two sets of edges with equal 128-bit fingerprints are the same set.
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(7), "v", "u"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, number = now, number + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where("u > v").distinct(), f"large-{number}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), f"star-{number}")
        scratch.drop(f"large-{number}", f"star-{number - 1}")
