"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, kept


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of links (u, v), root being the least node of its component and never equal to node.

    Each round points every neighbourhood at its least member, first for larger neighbours, then for smaller ones. A
    node of very many links is never gathered: a round is a minimum by key, joined back by that key. Rounds grow with
    the logarithm of the longest chain, so max_rounds is out of reach; past it, RuntimeError is raised.
    """
    edges = kept(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = kept(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small, last = large.join(low, "u"), edges
        edges = kept(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(large, last)
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
