"""Annual means, persistence, the top of the persistent ocean, basins, zonal means and regridding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sphere


def annual_mean(df: DataFrame, keys: list[str], depth: str, values: list[str]) -> DataFrame:
    """Sum of each value over the months, divided by the months whose depth is there and not 0."""
    good = F.count(F.when(F.col(depth) != 0, 1))
    return df.groupBy(*keys).agg(*((F.sum(v) / F.nullif(good, F.lit(0))).alias(v) for v in (depth, *values)))


def complete_years(df: DataFrame, keys: list[str], month: str, months: int = 12) -> DataFrame:
    """Rows of the years (keys) that have all months."""
    whole = df.groupBy(*keys).agg(F.count_distinct(month).alias("_n")).where(F.col("_n") == months).drop("_n")
    return df.join(whole, keys, "left_semi")


def persistence(df: DataFrame, keys: list[str], thick: str, months: int = 12, out: str = "pers") -> DataFrame:
    """Percentage of the months in which a bin has a thickness; bins with none are missing."""
    return df.groupBy(*keys).agg((100.0 * F.count(thick) / months).alias(out)).where(F.col(out) > 0)


def annual_bins(df: DataFrame, keys: list[str], depth: str, values: list[str], thick: str, months: int = 12) -> DataFrame:
    """annual_mean and persistence (pers) from one aggregate."""
    good = F.count(F.when(F.col(depth) != 0, 1))
    names = dict.fromkeys((depth, *values, thick))
    means = ((F.sum(v) / F.nullif(good, F.lit(0))).alias(v) for v in names)
    return df.groupBy(*keys).agg(*means, (100.0 * F.count(thick) / months).alias("pers"))


def with_bowl(df: DataFrame, keys: list[str], pers: str, depth: str, least: float = 99.0, deep: float = 300.0, out: str = "bowl_idx") -> DataFrame:
    """Bins with the index of their column's lightest persistent bin; without one, of the bin above the densest if the column is deeper
    than `deep`, else a null."""
    w = Window.partitionBy(*keys)
    persistent, deepest = F.min(F.when(F.col(pers) >= least, F.col("rho_idx"))).over(w), F.max(depth).over(w)
    return df.withColumn(out, F.coalesce(persistent, F.when(deepest > deep, F.max("rho_idx").over(w) - 1)))


def bowl(df: DataFrame, keys: list[str], pers: str, depth: str, values: list[str], least: float = 99.0, deep: float = 300.0) -> DataFrame:
    """Per column the index that with_bowl() gives its bins, and that bin's values."""
    # a window and not a join with the bins: that would deal them once more
    rows = with_bowl(df, keys, pers, depth, least, deep, "_bowl").select(*keys, "rho_idx", *values, "_bowl")
    at = F.when(F.col("rho_idx") == F.col("_bowl"), F.struct(F.lit(True), *(F.col(v).alias(f"ptop_{v}") for v in values)))
    found = rows.groupBy(*keys).agg(F.max("_bowl").alias("bowl_idx"), F.max(at).alias("_at"))
    return found.select(*keys, "bowl_idx", *(F.col(f"_at.ptop_{v}").alias(f"ptop_{v}") for v in values))


def with_global(df: DataFrame, basin: str = "basin", name: str = "Global") -> DataFrame:
    """Each row for its basin and for all basins together; rows without a basin for the latter only."""
    both = F.array_compact(F.array(F.lit(name), F.col(basin)))
    return df.withColumn(basin, F.explode(both))


def zonal_mean(df: DataFrame, keys: list[str], values: list[str], weight: Column | None = None) -> DataFrame:
    """Mean over longitude of whatever is there, weighted or not."""
    if weight is None:
        return df.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))
    return df.groupBy(*keys).agg(*(F.try_divide(F.sum(F.col(v) * weight), F.sum(F.when(F.col(v).isNotNull(), weight))).alias(v) for v in values))


def persistent_share(df: DataFrame, keys: list[str], pers: str, thick: str, out: str = "share") -> DataFrame:
    """Percentage of the column that is persistent: thickness-weighted mean of the persistence."""
    return df.groupBy(*keys).agg((F.sum(F.col(pers) * F.col(thick)) / F.sum(thick)).alias(out))


def persistent_totals(df: DataFrame, column: list[str], group: list[str], pers: str, thick: str, area: str, values: list[str], least: float = 98.0, eps: float = 1e-4) -> DataFrame:
    """Volume of the persistent bins per group, and of each value the thickness-weighted mean per column, averaged by area over
    the whole area of the group."""
    full = F.col(pers) >= least
    mean = lambda v: (F.sum(F.when(full, F.col(v) * F.col(thick))) / (F.sum(F.when(full, F.col(thick))) + eps)).alias(v)
    columns = df.groupBy(*column, *group, area).agg(F.coalesce(F.sum(F.when(full, F.col(thick))), F.lit(0.0)).alias("_h"), *(mean(v) for v in values))
    totals = [F.sum(F.col("_h") * F.col(area)).alias("volume")]
    return columns.groupBy(*group).agg(*totals, *((F.sum(F.col(v) * F.col(area)) / F.sum(area)).alias(v) for v in values))


def inverse_distance_weights(source: DataFrame, target: DataFrame, nearest: int = 4, tile: float = 5.0) -> DataFrame:
    """sphere.inverse_distance_weights() with the finest cubes about an eighth of `tile` degrees long; the result doesn't depend on it."""
    return sphere.inverse_distance_weights(source, target, nearest, max(1, math.ceil(math.log2(2 / math.radians(tile / 8)))))


def regrid(df: DataFrame, weights: DataFrame, cell: str, keys: list[str], values: list[str]) -> DataFrame:
    """Weighted means on the target cells; cells that are missing drop out of the weights.

    Weights: sphere.inverse_distance_weights(), merging.linear_weights(), or any table (src_cell, dst_cell, weight).
    """
    w = F.col("weight")
    joined = df.join(weights, F.col(cell) == F.col("src_cell"))
    means = joined.groupBy(*keys, F.col("dst_cell").alias(cell)).agg(
        *(F.try_divide(F.sum(F.col(v) * w), F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values)
    )
    return means


def zonal_transport(df: DataFrame, keys: list[str], flux: str, width: str, factor: float = 1e-6, out: str = "transport") -> DataFrame:
    """Sum over longitude of a flux per width (m2/s) times the cells' width, in 1e6 m3/s by default."""
    return df.groupBy(*keys).agg((F.sum(F.col(flux) * F.col(width)) * factor).alias(out))


def with_axes(df: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of another dataset's axis table in place of its own of the same names."""
    new = [c for c in axes.columns if c not in keys]
    return df.drop(*new).join(axes, keys)
