"""Statistics over ensemble members and models. Absent members have no row, so their number is always given or joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_window(df: DataFrame, time: str, start: int | None = None, end: int | None = None, last: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Times from start (inclusive) to end (exclusive), or the `last` times of each key (of the table without keys)."""
    if last is not None and not keys:
        return df.join(F.broadcast(df.agg(F.max(time).alias("_top")))).where(F.col(time) > F.col("_top") - last).drop("_top")  # one row
    if last is not None:
        newest = F.max(time).over(Window.partitionBy(*keys))
        return df.withColumn("_top", newest).where(F.col(time) > F.col("_top") - last).drop("_top")
    return df.where((F.col(time) >= start) & (F.col(time) < end))


def unequal_lengths(df: DataFrame, member: str, time: str) -> DataFrame:
    """(first, last, members): more than one row means that the members' time axes differ."""
    spans = df.groupBy(member).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    return spans.groupBy("first", "last").agg(F.count(F.lit(1)).alias("members"))


def zero_filled(df: DataFrame, zero: list[str]) -> DataFrame:
    """Missing to 0 in the columns where absence means none of it (depth, thickness, volume, persistence)."""
    return df.fillna(0.0, zero)


def presence(df: DataFrame, keys: list[str], value: str, members: int | Column, least: float = 50.0, out: str = "presence") -> DataFrame:
    """Percentage of the members with a value; points below `least` are missing."""
    n = members if isinstance(members, Column) else F.lit(members)
    return df.groupBy(*keys).agg((100.0 * F.count(value) / F.max(n)).alias(out)).where(F.col(out) >= least)


def ensemble_mean(df: DataFrame, keys: list[str], values: list[str], present: DataFrame | None = None) -> DataFrame:
    """Mean over members, at the points of `present` only if that is given."""
    means = df.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))
    return means if present is None else means.join(present, keys)


def zero_filled_mean(df: DataFrame, keys: list[str], value: str, members: int | Column) -> DataFrame:
    """Mean over all members, those without a row counted as 0: no rows are made for them."""
    n = members if isinstance(members, Column) else F.lit(members)
    return df.groupBy(*keys).agg((F.coalesce(F.sum(value), F.lit(0.0)) / F.max(n)).alias(value))


def anomaly(df: DataFrame, keys: list[str], time: str, value: str, start: int, end: int, out: str = "anomaly") -> DataFrame:
    """value minus its own mean over [start, end)."""
    base = F.avg(F.when((F.col(time) >= start) & (F.col(time) < end), F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.col(value) - base)


def sign_agreement(df: DataFrame, keys: list[str], value: str, out: str = "agree") -> DataFrame:
    """Mean over members of the sign; zero counts as +1."""
    return df.groupBy(*keys).agg(F.avg(F.when(F.col(value) < 0, -1.0).when(F.col(value) >= 0, 1.0)).alias(out))


def largest_member_std(df: DataFrame, keys: list[str], member: str, value: str, ddof: int = 0, out: str = "std") -> DataFrame:
    """Standard deviation in time of each member, and the largest over the members."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    return df.groupBy(*keys, member).agg(std(value).alias("_s")).groupBy(*keys).agg(F.max("_s").alias(out))


def model_spread(df: DataFrame, keys: list[str], value: str, ddof: int = 0, out: str = "spread") -> DataFrame:
    return df.groupBy(*keys).agg((F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)).alias(out))


def bowl_limit(df: DataFrame, keys: list[str], time: str, value: str, over_time: str = "mean", out: str = "siglimit") -> DataFrame:
    """Mean over members at each time, then the mean or largest over time."""
    steps = df.groupBy(*keys, time).agg(F.avg(value).alias("_v"))
    return steps.groupBy(*keys).agg((F.max if over_time == "max" else F.avg)("_v").alias(out))


def below_bowl(df: DataFrame, limit: DataFrame, keys: list[str], rho: str, siglimit: str, values: list[str]) -> DataFrame:
    """Values lighter than the limit become null, and all values of points without a limit."""
    df = df.join(limit.select(*keys, siglimit), keys, "left")
    return df.withColumns({v: F.when(F.col(rho) >= F.col(siglimit), F.col(v)) for v in values})


def two_level_mean(df: DataFrame, keys: list[str], model: str, value: str) -> DataFrame:
    """Mean of the models' means."""
    return df.groupBy(*keys, model).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.avg("_m").alias(value))


def ensemble_block(
    df: DataFrame, point: list[str], member: str, time: str, value: str, members: int | Column, base: tuple[int, int], least: float = 50.0, bowl: str | None = None,
) -> DataFrame:
    """All statistics of a member's field at once: (point, time, presence, mean, agree, spread, std[, bowl]), where at least `least` percent of the members have a value.

    presence in percent of `members`, mean and spread over members, agree: mean sign of the anomaly against each member's own mean over [base), std:
    largest standard deviation in time of a member at the point, bowl: mean over times of the members' mean of another column. df has one row per
    (member, point, time). The rows are dealt once, by point: the members' means and deviations are windows, and the statistics an
    aggregate, on rows that lie there already.
    """
    n = members if isinstance(members, Column) else F.lit(members)
    own = Window.partitionBy(*point, member)
    mean = F.avg(F.when((F.col(time) >= base[0]) & (F.col(time) < base[1]), F.col(value))).over(own)
    rows = df.repartition(*point).withColumn("_x", F.col(value) - mean).withColumn("_s", F.stddev_pop(value).over(own)).withColumn("_n", n)
    sign = F.when(F.col("_x") < 0, -1.0).when(F.col("_x") >= 0, 1.0)
    aggs = [(100.0 * F.count(value) / F.max("_n")).alias("presence"), F.avg(value).alias("mean"), F.avg(sign).alias("agree"), F.stddev_pop(value).alias("spread"), F.max("_s").alias("_s")]
    found = rows.groupBy(*point, time).agg(*aggs, *([F.avg(bowl).alias("bowl")] if bowl else []))
    whole = Window.partitionBy(*point)  # a member is present at some time of the point
    found = found.withColumn("std", F.max("_s").over(whole)).drop("_s")
    if bowl:
        found = found.withColumn("bowl", F.avg("bowl").over(whole))
    return found.where(F.col("presence") >= least)


def mean_of_models(df: DataFrame, keys: list[str], model: str, statistics: list[str], least: int = 1) -> DataFrame:
    """Means over models of each model's own statistics (its mean, agreement, bowl, ...), where at least `least` models have a row."""
    rows = df.groupBy(*keys).agg(*(F.avg(s).alias(s) for s in statistics), F.count_distinct(model).alias("models"))
    return rows.where(F.col("models") >= least)


def bowl_density(df: DataFrame, keys: list[str], rho: str, depth: str, bowl_depth: str, out: str = "bowl_rho") -> DataFrame:
    """Densest level whose depth is less than the bowl's while the next level reaches it."""
    after = F.lead(depth).over(Window.partitionBy(*keys).orderBy(rho))
    rows = df.withColumn("_after", after).where((F.col(depth) < F.col(bowl_depth)) & (F.col(bowl_depth) <= F.col("_after")))
    return rows.groupBy(*keys).agg(F.max(rho).alias(out))
