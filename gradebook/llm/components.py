"""Connected components of a link table by alternating large-star and small-star steps.

Each step is one aggregate (smallest neighbour) and one equi-join, staged in the shared folder; the number of steps
grows with the logarithm of the longest chain.  Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _lowest(pairs: DataFrame, strict: bool) -> DataFrame:
    """Each node's neighbours re-linked to the smallest node among them and itself."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = pairs.join(low, "u")
    if strict:   # large star: larger neighbours move
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link to another."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges, state = stage(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both, True).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = stage(_lowest(down, False).where("u <> v").distinct(), "edges")
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30))).alias("s")).first()
        if row["n"] == 0 or (row["n"], row["s"]) == state:
            break
        state = (row["n"], row["s"])
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
