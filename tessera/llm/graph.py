"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, release


def components(edges: DataFrame) -> DataFrame:
    """From columns a and b: node and root (the component's least node) for every node but the roots.

    The result is a kept table. Each round is two aggregations and two joins on node ids. Their results are written, so that nothing is recomputed
    and both sides of a join are plain shuffles, which adaptive execution splits at a node with very many edges. The number of rounds grows with the logarithm of the longest path. Edges may repeat or be loops.
    """
    e = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = keep(e, "edges"), None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            found = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            found.kept_at = e.kept_at
            return found
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = keep(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = keep(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = keep(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(e, least, large, lower)
        e, before = following, now
