"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paxcast.llm import common


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every node that an
    edge (``a``, ``b``) touches and that isn't itself the smallest.

    Alternating large-star and small-star rounds: every node first hands its
    larger neighbours, then its smaller ones, to the smallest it knows. Minima are
    combined before the shuffle and joined back, so a node with very many edges
    is an ordinary skewed join; each round's edges are written to the shared
    folder. Edges end as (node, smallest) after about log(n) rounds.
    """
    links = common.materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = common.materialise(
            small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
