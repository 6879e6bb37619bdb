"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the links; root is the smallest node reachable.

    Alternates large-star and small-star steps, each a min aggregate and a join, until the links form stars.
    Neighbour lists are never gathered: a hub costs one row per task in the aggregate, and the join on
    it can be split at run time. Self-links and nulls are ignored; repeated links count once.
    """
    stars = cut(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        stars = cut(small)
    roots = stars.select(F.col("v").alias("u"), "v").distinct()
    return stars.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
