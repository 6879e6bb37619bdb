"""Merges of two long tables along an axis: the last, next or nearest point, irregular intervals, interpolation in two dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(points: DataFrame, asked: DataFrame, keys: list[str], x: str, values: list[str], width: float | None = None) -> DataFrame:
    """asked with `before` and `after`: structs (x, values) of the points of the same keys at or before x, and at or after it; null if there are none.

    Both tables meet in one window sorted by x. Of several points at one x any one counts. With a width, keys are dealt in stretches of
    that length, so a key (or no key at all) with most of the rows is spread over tasks; each stretch takes the ends of the next ones that
    have points, of which there is a row per stretch.
    """
    point, row = F.struct(F.col(x), *(F.col(v) for v in values)), F.struct(*(F.col(c) for c in asked.columns))
    kinds = {"_p": points.select(point.alias("p")).schema["p"].dataType, "_row": asked.select(row.alias("r")).schema["r"].dataType}
    a = points.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), point.alias("_p"), F.lit(None).cast(kinds["_row"]).alias("_row"))
    b = asked.select(*keys, F.col(x).cast("double").alias("_x"), F.lit(None).cast(kinds["_p"]).alias("_p"), row.alias("_row"))
    both, deal = a.unionByName(b), list(keys)
    if width is not None:
        both, deal = both.withColumn("_b", F.floor(F.col("_x") / width)), [*keys, "_b"]
    is_asked = F.col("_row").isNotNull()
    up = Window.partitionBy(*deal).orderBy(F.col("_x"), is_asked).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*deal).orderBy(F.col("_x").desc(), is_asked).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_before", F.last("_p", True).over(up)).withColumn("_after", F.last("_p", True).over(down)).where(is_asked)
    if width is not None:
        ends = both.where("_b IS NOT NULL").groupBy(*deal).agg(F.min_by("_p", F.when(~is_asked, F.col("_x"))).alias("_lo"), F.max_by("_p", F.when(~is_asked, F.col("_x"))).alias("_hi"))
        w = Window.partitionBy(*keys).orderBy("_b")
        ends = ends.withColumn("_prev", F.last("_hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_next", F.first("_lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
        ends = ends.select(*(F.col(c).alias(f"_k_{c}") for c in deal), "_prev", "_next")
        same = F.lit(True)
        for c in deal:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        found = found.join(ends, same, "left").withColumn("_before", F.coalesce("_before", "_prev")).withColumn("_after", F.coalesce("_after", "_next"))
    known = F.col("_x").isNotNull()
    return found.select(*(F.col(f"_row.{c}").alias(c) for c in asked.columns), F.when(known, F.col("_before")).alias("before"), F.when(known, F.col("_after")).alias("after"))


def as_of(points: DataFrame, asked: DataFrame, keys: list[str], x: str, values: list[str], how: str = "last", width: float | None = None, at: str = "at") -> DataFrame:
    """asked with the values of the last, next or nearest point of its keys, and where on x that lies (`at`); of two equally near the lower. See neighbours()."""
    rows = neighbours(points, asked, keys, x, values, width)
    a, b = F.col("before"), F.col("after")
    if how == "nearest":
        best = F.when(a.isNull() | (b[x] - F.col(x) < F.col(x) - a[x]), b).otherwise(a)
    else:
        best = {"last": a, "next": b}[how]
    return rows.withColumn("_best", best).select(*asked.columns, F.col(f"_best.{x}").alias(at), *(F.col(f"_best.{v}").alias(v) for v in values))


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], x: str, low: str, high: str, values: list[str], width: float | None = None, closed: Column | None = None) -> DataFrame:
    """points with low, high and values of each interval [low, high) of their keys that holds x; points in none are left out.

    Intervals are rows of a table, differ per key and may overlap; those for which `closed` holds have their upper end as well. They are cut
    by stretches of `width`, by default their mean length, which makes at most three rows of each on average whatever their lengths; points meet
    them by equal keys and stretch, so the join is a hash or merge join, never a nested loop.
    """
    if width is None:
        width = intervals.agg(F.avg(F.col(high) - F.col(low))).first()[0] or 1.0  # one row
    stretch = lambda c: F.floor(F.col(c) / width)
    cut = intervals.where(F.col(low).isNotNull() & (F.col(high) >= F.col(low)))
    cut = cut.select(*keys, low, high, *values, (closed if closed is not None else F.lit(False)).alias("_closed"), F.explode(F.sequence(stretch(low), stretch(high))).alias("_b"))
    rows = points.withColumn("_b", stretch(x)).join(cut, [*keys, "_b"])
    inside = (F.col(x) >= F.col(low)) & ((F.col(x) < F.col(high)) | (F.col("_closed") & (F.col(x) == F.col(high))))
    return rows.where(inside).select(*points.columns, low, high, *values)


def segments(axis: DataFrame, keys: list[str], x: str, low: str, high: str, last: str = "_last") -> DataFrame:
    """(keys, low, high, last) of the neighbouring points of each key's axis; `last` marks the upmost. An axis of one point is a segment without length."""
    points = axis.select(*keys, F.col(x).cast("double").alias(low)).where(F.col(low).isNotNull()).distinct()
    rows = points.withColumn(high, F.lead(low).over(Window.partitionBy(*keys).orderBy(low))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    rows = rows.withColumn(high, F.when(F.col("_n") == 1, F.col(low)).otherwise(F.col(high))).where(F.col(high).isNotNull())
    top = F.max(high).over(Window.partitionBy(*keys))
    return rows.withColumn(last, F.col(high) == top).drop("_n")


def corners(targets: DataFrame, axes: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """targets with, for each of the axes' columns c, the corners of the grid cell that holds them: c_at and, in all, `weight` (linear in each
    axis, zero weights left out). axes[c] has (keys, c). Targets outside of an axis' range have no corners."""
    rows = targets
    for c, axis in axes.items():
        parts = segments(axis, keys, c, "_low", "_high")
        rows = in_intervals(rows, parts, keys, c, "_low", "_high", ["_last"], closed=F.col("_last")).withColumn(f"_share_{c}", F.coalesce(F.try_divide(F.col(c) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)))
        ends = F.array(F.struct(F.col("_low").alias("at"), (1 - F.col(f"_share_{c}")).alias("w")), F.struct(F.col("_high").alias("at"), F.col(f"_share_{c}").alias("w")))
        rows = rows.withColumn(f"_ends_{c}", ends).drop("_low", "_high", "_last", f"_share_{c}")
    weight = F.lit(1.0)
    for c in axes:
        rows = rows.withColumn(f"_e_{c}", F.explode(F.filter(f"_ends_{c}", lambda e: e["w"] > 0)))
        weight = weight * F.col(f"_e_{c}.w")
    return rows.select(*targets.columns, *(F.col(f"_e_{c}.at").alias(f"{c}_at") for c in axes), weight.alias("weight"))


def interpolate_2d(df: DataFrame, keys: list[str], x: str, y: str, value: str, targets: DataFrame, whole: bool = True) -> DataFrame:
    """(keys, x, y, value) at the distinct targets (keys, x, y): bilinear over the grid of df (keys, x, y, value), that is linear along one axis, then
    along the other. With `whole` a missing corner makes the value missing, else its weight goes to the others. Outside of the grid: null."""
    asked = targets.select(*keys, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).distinct()
    found = corners(asked, {c: df.select(*keys, c) for c in (x, y)}, keys)
    field = df.select(*keys, F.col(x).cast("double").alias(f"{x}_at"), F.col(y).cast("double").alias(f"{y}_at"), F.col(value).alias("_v"))
    joined = found.join(field, [*keys, f"{x}_at", f"{y}_at"], "left").groupBy(*keys, x, y)
    sums = joined.agg(F.sum(F.col("_v") * F.col("weight")).alias("_s"), F.sum(F.when(F.col("_v").isNotNull(), F.col("weight"))).alias("_w"), F.count(F.when(F.col("_v").isNull(), 1)).alias("_gaps"))
    known = F.col("_gaps") == 0 if whole else F.lit(True)
    sums = sums.select(*keys, x, y, F.when(known, F.try_divide(F.col("_s"), F.col("_w"))).alias(value))
    return asked.join(sums, [*keys, x, y], "left")


def linear_weights(source: DataFrame, target: DataFrame, period: float | None = 360.0) -> DataFrame:
    """(src_cell, dst_cell, weight) of the corners of the source grid's cell around each target cell, for time_space.regrid(), which gives the weight
    of missing corners to the others.

    source and target: (cell, lat, lon); the source is a grid of latitudes and longitudes, the latter with a period (None: none), so a cell
    reaches over the date line. Corners without a source cell drop out; targets beyond the first and last latitude, or without any corner, have no row.
    """
    lon = F.pmod(F.col("lon").cast("double"), F.lit(period)) if period else F.col("lon").cast("double")
    s = source.select(F.col("cell").alias("src_cell"), F.col("lat").cast("double").alias("lat"), lon.alias("lon"))
    t = target.select(F.col("cell").alias("dst_cell"), F.col("lat").cast("double").alias("lat"), lon.alias("lon"))
    axis = s.select("lon").distinct()
    if period:
        ends = axis.agg(F.min("lon").alias("a"), F.max("lon").alias("b"))
        axis = axis.unionByName(ends.select(F.explode(F.array(F.col("a") + period, F.col("b") - period)).alias("lon")))
    found = corners(t, {"lat": s.select("lat"), "lon": axis}, [])
    at = F.pmod(F.col("lon_at"), F.lit(period)) if period else F.col("lon_at")
    # nine decimals: the same longitude comes out of two ways to compute it
    cells = s.select("src_cell", F.col("lat").alias("lat_at"), F.round("lon", 9).alias("_lon"))
    return found.withColumn("_lon", F.round(at, 9)).join(cells, ["lat_at", "_lon"]).groupBy("src_cell", "dst_cell").agg(F.sum("weight").alias("weight"))
