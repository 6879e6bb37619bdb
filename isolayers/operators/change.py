"""Change fields: period differences, derivatives, migration of isopycnals, significance, sections, remapping to depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_difference(df: DataFrame, keys: list[str], time: str, value: str, first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """Means over two periods (both ends included) and their difference (change)."""
    mean = lambda p: F.avg(F.when(F.col(time).between(*p), F.col(value)))
    rows = df.where(F.col(time).between(*first) | F.col(time).between(*second)).groupBy(*keys).agg(mean(first).alias("mean1"), mean(second).alias("mean2"))
    return rows.withColumn("change", F.col("mean2") - F.col("mean1"))


def climatology(df: DataFrame, keys: list[str], time: str, value: str, agree: str, final: tuple[int, int]) -> DataFrame:
    """Mean of a field over all times, and mean of the models' agreement over the final period (both ends included): (keys, value, agree)."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value), F.avg(F.when(F.col(time).between(*final), F.col(agree))).alias(agree))


def forward_derivative(df: DataFrame, keys: list[str], axis: str, value: str, out: str = "slope") -> DataFrame:
    """(next value - value) / (next axis - axis); null at the end."""
    w = Window.partitionBy(*keys).orderBy(axis)
    return df.withColumn(out, F.try_divide(F.lead(value).over(w) - F.col(value), F.lead(axis).over(w) - F.col(axis)))


def without_mean(df: DataFrame, keys: list[str], value: str, out: str = "anomaly") -> DataFrame:
    """value minus its mean over the rows of the keys (zonal, or per density: spiciness)."""
    return df.withColumn(out, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def significant(change: Column, error: Column, level: float = 1.64, factor: float = 1.1) -> Column:
    """1 if |change| reaches factor * level * error (1.64: 90 %, 2.58: 99 %), else 0."""
    return F.when(F.abs(change) >= factor * level * error, 1).otherwise(0)


def bowl_from_data(df: DataFrame, keys: list[str], rho: str, value: str, out: str = "bowl") -> DataFrame:
    """Lightest density with a value."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(value).isNotNull(), F.col(rho))).alias(out))


def nearest(df: DataFrame, keys: list[str], axis: str, target: Column, values: list[str]) -> DataFrame:
    """Per key the row nearest to a target on an axis; of two equally near the lower."""
    row = F.min_by(F.struct(axis, *values), F.struct(F.abs(F.col(axis) - target), F.col(axis)))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, F.col(f"_r.{axis}").alias(axis), *(F.col(f"_r.{v}").alias(v) for v in values))


def cosine_section(df: DataFrame, keys: list[str], lat: str, value: str, low: float, high: float) -> DataFrame:
    """cos(latitude)-weighted mean over a latitude band."""
    w = F.cos(F.radians(lat))
    rows = df.where(F.col(lat).between(low, high))
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(F.when(F.col(value).isNotNull(), w))).alias(value))


def capped_section(df: DataFrame, keys: list[str], value: str, most: float = 4.0) -> DataFrame:
    """Mean over a longitude band; values beyond `most` count as 0."""
    return df.groupBy(*keys).agg(F.avg(F.when(F.col(value) > most, 0.0).otherwise(F.col(value))).alias(value))


#: Values this share of a tolerance apart are inside of it; what is left keeps the order of a sum from deciding on values just at it.
INSIDE = 1 - 1e-9


def migration(df: DataFrame, keys: list[str], lat: str, rho: str, before: str, after: str, eps: float, lat_band: int = 5, rho_band: float = 0.5) -> DataFrame:
    """For each point the nearest point (nearer than lat_band and rho_band) whose later value is within eps of its earlier one.

    Returns keys, lat, rho, d_lat and d_rho (minus the offset). Points meet in buckets of value, latitude and density and their
    neighbours, so the join has equal keys and stays small; ties go to the lower latitude, then density.
    """
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("v"), F.lit(b).alias("y"), F.lit(c).alias("r")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))))
    bucket = lambda x: (F.floor(F.col(x) / eps), F.floor(F.col(lat) / lat_band), F.floor(F.col(rho) / rho_band))
    v, y, r = bucket(before)
    a = df.where(F.col(before).isNotNull()).select(*keys, F.col(lat).alias("_y"), F.col(rho).alias("_r"), F.col(before).alias("_x"), v.alias("v"), y.alias("y"), r.alias("r"), near.alias("n"))
    a = a.select(*keys, "_y", "_r", "_x", (F.col("v") + F.col("n.v")).alias("v"), (F.col("y") + F.col("n.y")).alias("y"), (F.col("r") + F.col("n.r")).alias("r"))
    v, y, r = bucket(after)
    b = df.where(F.col(after).isNotNull()).select(*keys, F.col(lat).alias("_y2"), F.col(rho).alias("_r2"), F.col(after).alias("_x2"), v.alias("v"), y.alias("y"), r.alias("r"))
    dy, dr = F.col("_y2") - F.col("_y"), F.col("_r2") - F.col("_r")
    rows = a.join(b, [*keys, "v", "y", "r"]).where((F.abs(F.col("_x") - F.col("_x2")) < eps * INSIDE) & (F.abs(dy) < lat_band) & (F.abs(dr) < rho_band))
    best = F.min_by(F.struct((-dy).alias("d_lat"), (-dr).alias("d_rho")), F.struct(dy * dy + dr * dr, F.col("_y2"), F.col("_r2")))
    found = rows.groupBy(*keys, F.col("_y").alias(lat), F.col("_r").alias(rho)).agg(best.alias("_b"))
    return found.select(*keys, lat, rho, "_b.d_lat", "_b.d_rho")


def migration_refined(
    df: DataFrame, keys: list[str], lat: str, rho: str, before: str, after: str, eps: float, step: float = 0.01, lat_band: float = 5.0, rho_band: float = 0.5, buckets: int = 8,
) -> DataFrame:
    """migration() with the later field on the multiples of `step` degrees of latitude, linear between neighbouring latitudes.

    For each point (earlier value) the nearest refined point (later value) nearer than lat_band and rho_band whose value is within eps of its own: keys,
    lat, rho, d_lat and d_rho (minus the offset); ties go to the lower density, then latitude. No refined grid is made: two
    neighbouring latitudes are one segment of values, points meet the segments by equal buckets of value (`buckets` * eps wide), latitude and density, and
    the nearest multiple of step on the stretch of a segment that is close in value and latitude follows in closed form. A segment has a row
    for each bucket of value that it crosses, and its ends' buckets of latitude; a point has nine. A missing latitude or value between two
    points breaks no segment unless its row is there with a null.
    """
    w = Window.partitionBy(*keys, rho).orderBy(lat)
    rows = df.select(*keys, F.col(lat).cast("double").alias("_a"), F.col(rho).alias("_r2"), F.col(after).alias("_va"), F.lead(F.col(lat).cast("double")).over(w).alias("_b"), F.lead(after).over(w).alias("_vb"))
    # the last latitude, and one before a null, is a segment of its own point
    rows = rows.where(F.col("_va").isNotNull()).withColumn("_b", F.when(F.col("_vb").isNotNull(), F.col("_b")).otherwise(F.col("_a"))).withColumn("_vb", F.coalesce("_vb", "_va"))
    size = eps * buckets
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo), F.floor(hi)))
    rows = rows.withColumn("_v", span((F.least("_va", "_vb") - eps) / size, (F.greatest("_va", "_vb") + eps) / size))
    rows = rows.withColumn("_y", span(F.col("_a") / lat_band, F.col("_b") / lat_band)).withColumn("_d", F.floor(F.col("_r2") / rho_band))
    near = F.explode(F.array(*(F.struct(F.lit(b).alias("y"), F.lit(c).alias("d")) for b in (-1, 0, 1) for c in (-1, 0, 1)))).alias("_n")
    points = df.where(F.col(before).isNotNull()).select(*keys, F.col(lat).cast("double").alias("_lat"), F.col(rho).alias("_rho"), F.col(before).alias("_x"), near)
    points = points.select(*keys, "_lat", "_rho", "_x", F.floor(F.col("_x") / size).alias("_v"), (F.floor(F.col("_lat") / lat_band) + F.col("_n.y")).alias("_y"), (F.floor(F.col("_rho") / rho_band) + F.col("_n.d")).alias("_d"))
    both = points.join(rows, [*keys, "_v", "_y", "_d"]).where(F.abs(F.col("_r2") - F.col("_rho")) < rho_band)
    slope = F.try_divide(F.col("_vb") - F.col("_va"), F.col("_b") - F.col("_a"))
    one, two = F.col("_a") + F.try_divide(F.col("_x") - eps - F.col("_va"), slope), F.col("_a") + F.try_divide(F.col("_x") + eps - F.col("_va"), slope)
    # latitudes are counted in steps; the ends of the windows of value and latitude are open, those of the segment closed
    steps = lambda x: F.round(x / step, 7)
    flat = F.coalesce(slope == 0, F.lit(True))
    low_open = F.greatest(F.col("_lat") - lat_band, F.when(~flat, F.least(one, two)))
    high_open = F.least(F.col("_lat") + lat_band, F.when(~flat, F.greatest(one, two)))
    low = F.greatest(F.ceil(steps(F.col("_a"))), F.floor(steps(low_open)) + 1)
    high = F.least(F.floor(steps(F.col("_b"))), F.ceil(steps(high_open)) - 1)
    both = both.where(~flat | (F.abs(F.col("_va") - F.col("_x")) < eps * INSIDE)).withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    # of two multiples next to the point the nearer one, the lower if they are equally near
    own = steps(F.col("_lat"))
    at = F.least(F.greatest(F.ceil(own - 0.5), F.col("_low")), F.col("_high"))
    dy, dr = at * step - F.col("_lat"), F.col("_r2") - F.col("_rho")
    best = F.min_by(F.struct((-dy).alias("d_lat"), (-dr).alias("d_rho")), F.struct(F.round(dy * dy + dr * dr, 9), F.col("_r2"), at))
    found = both.groupBy(*keys, "_lat", "_rho").agg(best.alias("_m"))
    return found.select(*keys, F.col("_lat").alias(lat), F.col("_rho").alias(rho), "_m.d_lat", "_m.d_rho")


def remap_to_depth(df: DataFrame, keys: list[str], depth: str, volume: str, value: str, edges: list[float]) -> DataFrame:
    """Volume-weighted mean of the isopycnals whose depth is in [edge, next edge); volumes of 0 are skipped."""
    at = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col(depth))) - 1
    rows = df.where(F.col(depth).isNotNull() & (F.col(volume) > 0)).withColumn("z_idx", at).where((F.col("z_idx") >= 0) & (F.col("z_idx") < len(edges) - 1))
    return rows.groupBy(*keys, "z_idx").agg((F.sum(F.col(value) * F.col(volume)) / F.sum(volume)).alias(value), F.sum(volume).alias(volume))


def gaps_filled(df: DataFrame, keys: list[str], axis: str, value: str, out: str = "filled") -> DataFrame:
    """Linear interpolation of nulls between neighbours that have values; none beyond the ends."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(axis).alias("x"), F.col(value).alias("v")))
    w = Window.partitionBy(*keys).orderBy(axis)
    a = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_a", a).withColumn("_b", b)
    line = F.col("_a.v") + (F.col(axis) - F.col("_a.x")) / F.nullif(F.col("_b.x") - F.col("_a.x"), F.lit(0.0)) * (F.col("_b.v") - F.col("_a.v"))
    return df.withColumn(out, F.coalesce(F.col(value), line)).drop("_a", "_b")


def volume_refill(density: DataFrame, levels: DataFrame, keys: list[str], volume: str, bottom: DataFrame | None = None) -> DataFrame:
    """Depth of each isopycnal such that the volume below it equals that below the depth: (keys, rho_idx, depth).

    density: (keys, rho_idx, volume), levels: (keys, z, volume of the layer below z), bottom: (keys, bottom), the depth of the sea floor, which has
    no volume below it. Volumes are summed from the bottom, then the depth is interpolated over the sum, with the tables merged in one
    window; where several depths have the same volume below them, one that is met exactly is the shallowest. Isopycnals without volume below them
    are left out, those with more than all levels have lie at the first. Without a bottom, the densest isopycnals end at the deepest level.
    """
    up = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    none = F.lit(None)
    z = levels.select(*keys, F.col("z").cast("double").alias("_z"), F.sum(volume).over(up("z")).alias("_x")).where("_x > 0")
    if bottom is not None:
        z = z.unionByName(bottom.select(*keys, F.col("bottom").cast("double").alias("_z"), F.lit(0.0).alias("_x")))
    rho = density.select(*keys, "rho_idx", F.sum(volume).over(up("rho_idx")).alias("_x")).where("_x > 0")
    kind = density.schema["rho_idx"].dataType
    both = z.select(*keys, none.cast(kind).alias("rho_idx"), F.col("_x").cast("double"), "_z").unionByName(rho.select(*keys, "rho_idx", F.col("_x").cast("double"), none.cast("double").alias("_z")))
    at = F.when(F.col("_z").isNotNull(), F.struct("_x", "_z"))
    deeper = F.last(at, True).over(Window.partitionBy(*keys).orderBy("_x", F.col("_z").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    higher = F.last(at, True).over(Window.partitionBy(*keys).orderBy(F.col("_x").desc(), F.col("_z").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_a", deeper).withColumn("_b", higher).where("rho_idx IS NOT NULL")
    a, b = F.col("_a"), F.col("_b")
    line = a["_z"] + (F.col("_x") - a["_x"]) / F.nullif(b["_x"] - a["_x"], F.lit(0.0)) * (b["_z"] - a["_z"])
    return rows.select(*keys, "rho_idx", F.when(a["_x"] == F.col("_x"), a["_z"]).when(a.isNull(), b["_z"]).when(b.isNull(), a["_z"]).otherwise(line).alias("depth"))


def painted(depths: DataFrame, axis: DataFrame, keys: list[str], depth: str, rho: str, z: str, bottom: str | None = None) -> DataFrame:
    """axis (keys, z) with the densest isopycnal of depths (keys, rho, depth) that lies at z or above it, null above all; below the
    column's `bottom`, a column of axis, nothing is painted. Both tables are merged in one sorted window."""
    kind = depths.schema[rho].dataType
    row = F.struct(*(F.col(c) for c in axis.columns))
    a = depths.where(F.col(depth).isNotNull()).select(*keys, F.col(depth).cast("double").alias("_z"), F.col(rho).alias("_r"), F.lit(None).cast(axis.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    b = axis.select(*keys, F.col(z).cast("double").alias("_z"), F.lit(None).cast(kind).alias("_r"), row.alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_z", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_top", F.max("_r").over(w)).where("_row IS NOT NULL")
    found = F.col("_top") if bottom is None else F.when(F.col("_z") <= F.col(f"_row.{bottom}"), F.col("_top"))
    return rows.select(*(F.col(f"_row.{c}").alias(c) for c in axis.columns if c != rho), found.alias(rho))


def mid_period(df: DataFrame, mean: str, change: str) -> DataFrame:
    """The fields of the first and the second period (begin, end), from their mean and their change."""
    return df.withColumns({"begin": F.col(mean) - F.col(change) / 2, "end": F.col(mean) + F.col(change) / 2})


def refined(df: DataFrame, keys: list[str], axis: str, value: str, parts: int = 100) -> DataFrame:
    """value interpolated at `parts` equal steps between neighbouring points of an axis, the points themselves included."""
    w = Window.partitionBy(*keys).orderBy(axis)
    rows = df.select(*keys, axis, value, F.lead(axis).over(w).alias("_a"), F.lead(value).over(w).alias("_v"))
    steps = F.when(F.col("_a").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))
    share = F.col("_k") / parts
    at = lambda x, y: F.when(F.col("_k") == 0, F.col(x)).otherwise(F.col(x) + share * (F.col(y) - F.col(x)))
    return rows.withColumn("_k", F.explode(steps)).select(*keys, at(axis, "_a").alias(axis), at(value, "_v").alias(value))


def masked_column(df: DataFrame, limits: DataFrame, keys: list[str], depth: str, value: str, top: str, bottom: str) -> DataFrame:
    """value becomes null above `top` and below `bottom` of the column's limits; a null limit doesn't mask."""
    rows = df.join(limits.select(*keys, top, bottom), keys, "left")
    outside = F.coalesce(F.col(depth) < F.col(top), F.lit(False)) | F.coalesce(F.col(depth) > F.col(bottom), F.lit(False))
    return rows.withColumn(value, F.when(~outside, F.col(value))).drop(top, bottom)


def columns_with(df: DataFrame, keys: list[str], value: str, least: int = 4) -> DataFrame:
    """Rows of the columns that have at least `least` values (gaps are filled in such columns only)."""
    n = F.count(value).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def remap_by_interpolation(df: DataFrame, keys: list[str], depth: str, volume: str, value: str, targets: DataFrame, target: str) -> DataFrame:
    """Field at target depths: value times volume and volume, each interpolated over depth, divided; null outside of the column or without volume."""
    from .columns import at_levels

    rows = df.withColumn("_xv", F.col(value) * F.col(volume))
    found = at_levels(rows, keys, depth, ["_xv", volume], targets, target)
    return found.select(*keys, target, F.try_divide(F.col("_xv"), F.col(volume)).alias(value))
