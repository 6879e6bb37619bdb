"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import new_folder


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], buckets: int = 1024, most: int = 100_000) -> DataFrame:
    """(keys, share, value): the quantile of each share, linear between the two values next to it; nulls don't count, keys without values have no row.

    Distributed selection instead of an aggregate that holds all values of a group: a histogram of `buckets` equal bins finds the bin that holds each
    wanted rank, then the rows of that bin alone are counted again in finer bins, until no bin holds more than `most` rows of different values,
    which are then ranked. Ties end a search at once. Per round one number comes to the driver, and a row per key and rank is written to the shared folder and joined.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    on = [F.col(f"_k_{k}").eqNullSafe(F.col(k)) for k in keys]
    named = [F.col(k).alias(f"_k_{k}") for k in keys]
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share"), (q * (F.col("_n") - 1)).alias("at")) for q in shares))).alias("_q")
    wanted = whole.select(*keys, "_lo", "_hi", "_n", place)
    rank = F.explode(F.array_distinct(F.array(F.floor("_q.at"), F.ceil("_q.at")))).alias("_rank")
    ranks = wanted.select(*keys, "_lo", "_hi", rank).distinct()
    # a search: rank, the values that may have it, how many are below them, how many they are
    open_ = ranks.join(whole.select(*named, "_n"), _all(on)).select(*keys, "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_held"))
    while True:
        # a table of its own in the shared folder: the next round reads it twice, and a plan of many rounds would double with each
        path, schema = new_folder(df.sparkSession, "selection"), open_.schema
        open_.write.parquet(path)
        open_ = df.sparkSession.read.schema(schema).parquet(path)
        top = open_.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_held")))).first()[0] or 0
        if top <= most:
            break
        spans = open_.select(*named, "_lo", "_hi", "_below").distinct()
        share = (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        bin_ = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 1))
        inside = rows.join(spans, _all(on) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        bins = inside.groupBy(*keys, "_lo", "_hi", "_below", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
        w = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_less", F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
        bins = bins.select(*named, F.col("_lo").alias("_l"), F.col("_hi").alias("_h"), "_less", "_c", "_a", "_z")
        hit = _all(on) & (F.col("_lo") == F.col("_l")) & (F.col("_hi") == F.col("_h")) & (F.col("_rank") >= F.col("_less")) & (F.col("_rank") < F.col("_less") + F.col("_c"))
        open_ = open_.join(bins, hit).select(*keys, "_rank", F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), F.col("_less").alias("_below"), F.col("_c").alias("_held"))
    spans = open_.where("_lo < _hi").select(*named, "_lo", "_hi", "_below").distinct()
    inside = rows.join(spans, _all(on) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    order = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v")
    found = inside.select(*named, (F.col("_below") + F.row_number().over(order) - 1).alias("_r"), F.col("_v").alias("_found"))
    found = open_.where("_lo < _hi").join(found, _all(on) & (F.col("_rank") == F.col("_r"))).select(*keys, "_rank", "_found")
    found = found.unionByName(open_.where("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_found")))
    found = found.select(*named, "_rank", "_found")
    both = wanted.join(found, _all(on) & F.col("_rank").isin(F.floor("_q.at"), F.ceil("_q.at")))
    low, high = F.min("_found"), F.max("_found")
    part = F.max(F.col("_q.at") - F.floor("_q.at"))
    return both.groupBy(*keys, F.col("_q.share").alias("share")).agg((low + part * (high - low)).alias(value))


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
