"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one equi-join; the edges of a step are stored
in the shared folder, and the loop ends when a step changes nothing. Nothing
but two numbers per step reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_steps: int = 60) -> DataFrame:
    """Rows (node, component): nodes of the edges and the least node of their component.

    Edges with a null end or from a node to itself add nothing; repeated edges
    count once. Nodes without edges aren't in the result. No edges, no rows.
    """
    now = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null and u != v")
    now, mark = stored(now.distinct(), "edges"), None
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_steps):
        after = stored(_small_star(_large_star(now)), "edges")
        discard(now)
        now = after
        # sums of hashes wrap in decimals, not in longs: ANSI mode raises on overflow
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
