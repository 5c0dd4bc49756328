"""Connected components by alternating large-star and small-star steps.

Minima are taken by groupBy, whose partial sums shrink a hub's rows before the
shuffle; the joins that follow read two written tables, so that AQE can split
a hub's partition. Nothing goes to the driver but two counts a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v longs) to node, root: the least node that each node reaches. Nodes with no edge to another are absent."""
    ordered = lambda df: df.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialise(ordered(edges).distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.count_distinct("u")).first()
        # A forest of stars: one parent for each child, and no parent is a child.
        if found == mark or (found[0] == found[2] and now.select(F.col("v").alias("u")).join(now.select("u"), "u", "left_semi").isEmpty()):
            break
        mark = found
        both = now.union(now.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        wide = materialise(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large-star")
        low = materialise(wide.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = wide.join(low, "u")
        narrow = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v"))
        after = materialise(narrow.distinct(), "edges")
        for old in (now, least, wide, low):
            discard(old)
        now = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(now.select("v", "v").distinct())
