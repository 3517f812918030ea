"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import release, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not its component's smallest. edges: columns u and v, longs.

    Each round is written to the shared folder, so a lost executor costs one round. Self loops and repeats are ignored.
    """
    now = stage(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        seen_now = Observation()
        # the count and a sum over the edges are taken while they are written
        stars = _small_star(_large_star(now)).observe(seen_now, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        after = stage(stars, "edges")
        release(now)
        now = after
        if seen_now.get == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = seen_now.get
