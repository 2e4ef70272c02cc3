"""Connected components of a set of undirected links, by alternating star contractions.

Large-star links every larger neighbour of a node to the smallest of its closed neighbourhood, small-star
the smaller ones; both keep connectivity, and they end in stars around each component's smallest node.
Neighbourhoods are only ever aggregated (a minimum), never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

#: Links in a partition: few links need few tasks and files, whatever the session's number of partitions.
LINKS_EACH = 100_000


def _large_star(links: DataFrame, parts: int) -> DataFrame:
    both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
    return both.join(least, "u").coalesce(parts).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, parts: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    pairs = F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))
    return down.join(least, "u").coalesce(parts).select(F.explode(pairs).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """``u, v`` links of longs to ``node, root``: a row for each node of a link, root the smallest it reaches."""
    most = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = lambda x: x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
    held = links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v"), "links")
    before = known(links)
    while True:
        parts = min(most, 1 + before["n"] // LINKS_EACH)
        links = links.coalesce(parts)
        turned = stage(_small_star(_large_star(links, parts), parts).where("u != v").distinct().coalesce(parts), "links")
        after = known(turned)
        discard(held)
        held = links = turned
        if before == after:
            break
        before = after
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
