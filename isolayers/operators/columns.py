"""Water columns: from depth levels onto density bins. Columns of a table are named by the caller.

All windows of this module share the keys of the column, so a table dealt by them once needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.density_grid import Grid


def level_thickness(df: DataFrame, keys: list[str], lev: str, bound: str, last: str = "previous", out: str = "dz") -> DataFrame:
    """Thickness of each level from the upper bounds: next bound minus own; the last level takes the previous thickness,
    or half of it (last="half")."""
    w = Window.partitionBy(*keys).orderBy(lev)
    own = F.lead(bound).over(w) - F.col(bound)
    before = F.col(bound) - F.lag(bound).over(w)
    return df.withColumn(out, F.coalesce(own, before * 0.5 if last == "half" else before))


def valid_columns(df: DataFrame, keys: list[str], lev: str, value: str, first: int = 1) -> DataFrame:
    """Columns whose first level has a value."""
    top = F.max(F.when((F.col(lev) == first) & F.col(value).isNotNull(), 1)).over(Window.partitionBy(*keys))
    return df.withColumn("_top", top).where("_top = 1").drop("_top")


def bottom_level(df: DataFrame, keys: list[str], lev: str, value: str, first: int = 1, out: str = "bottom") -> DataFrame:
    """The last level before the first missing one; columns whose first level is missing have no row."""
    w = Window.partitionBy(*keys).orderBy(lev)
    rows = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w))
    return rows.where(F.col(lev) == F.col("_n") + first - 1).groupBy(*keys).agg(F.max(lev).alias(out))


def sub_profile(df: DataFrame, keys: list[str], lev: str, rho: str, least: float = 0.2) -> DataFrame:
    """Levels from the lightest to the densest one; the whole column if its bottom exceeds its surface by less than `least`."""
    # in the order of the levels, like the windows that follow, so that all share one sort
    w = Window.partitionBy(*keys).orderBy(lev).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # of equal densities: the deepest lightest and the shallowest densest
    lightest = F.min(F.struct(F.col(rho), -F.col(lev))).over(w)
    densest = F.max(F.struct(F.col(rho), -F.col(lev))).over(w)
    ends = F.max(F.struct(F.col(lev), F.col(rho))).over(w)[rho] - F.min(F.struct(F.col(lev), F.col(rho))).over(w)[rho]
    df = df.where(F.col(rho).isNotNull()).select("*", lightest.alias("_l"), densest.alias("_d"), ends.alias("_e"))
    inside = (F.col(lev) >= -F.col("_l.col2")) & (F.col(lev) <= -F.col("_d.col2"))
    return df.where((F.col("_e") < least) | inside).drop("_l", "_d", "_e")


def on_density(df: DataFrame, keys: list[str], lev: str, rho: str, values: list[str], grid: Grid) -> DataFrame:
    """Linear interpolation of each value at the grid's levels: one row per column and level inside the range of rho.

    Each pair of neighbouring levels makes the grid levels in [rho, next rho) by a closed-form range of indices. If several
    pairs reach a level, the deepest wins: a pair leaves out what deeper ones make, so each bin is made once, in the window of
    the levels, and bins are neither sorted nor grouped.
    """
    w = Window.partitionBy(*keys).orderBy(lev)
    nexts = [F.lead(v).over(w).alias(f"_next_{v}") for v in (rho, *values)]
    rows = df.where(F.col(rho).isNotNull()).select(*keys, lev, rho, *values, *nexts)
    first = F.greatest(grid.first_at_or_above(F.col(rho)), F.lit(0))
    last = F.least(grid.first_at_or_above(F.col(f"_next_{rho}")) - 1, F.lit(grid.size - 1))
    rows = rows.withColumn("_a", F.when(F.col(f"_next_{rho}") > F.col(rho), first)).withColumn("_b", last)
    rows = rows.withColumn("_own", F.when(F.col("_a") <= F.col("_b"), F.sequence("_a", "_b")))
    deeper = F.flatten(F.collect_list("_own").over(w.rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.withColumn("_deeper", deeper).withColumn("rho_idx", F.explode(F.array_except("_own", "_deeper")))
    share = (grid.value(F.col("rho_idx")) - F.col(rho)) / (F.col(f"_next_{rho}") - F.col(rho))
    return rows.select(*keys, "rho_idx", *((F.col(v) + share * (F.col(f"_next_{v}") - F.col(v))).alias(v) for v in values))


def bottom_bin(df: DataFrame, keys: list[str], lev: str, rho: str, values: list[str], grid: Grid) -> DataFrame:
    """Per column the first grid level at or above its largest density, with the values of the densest level."""
    top = df.where(F.col(rho).isNotNull()).groupBy(*keys).agg(
        F.max(rho).alias("_rho"), F.max_by(F.struct(*values), F.struct(F.col(rho), F.col(lev))).alias("_v")
    )
    at = F.greatest(grid.first_at_or_above(F.col("_rho")), F.lit(0)).alias("rho_idx")
    return top.select(*keys, at, *(F.col(f"_v.{v}").alias(v) for v in values)).where(F.col("rho_idx") < grid.size)


def bin_thickness(df: DataFrame, keys: list[str], depth: str, most: float = 6000.0, out: str = "thick") -> DataFrame:
    """Depth minus the depth of the bin before (0 above the first); rows with a thickness outside (0, most) go."""
    w = Window.partitionBy(*keys).orderBy("rho_idx")
    df = df.withColumn(out, F.col(depth) - F.coalesce(F.lag(depth).over(w), F.lit(0.0)))
    return df.where((F.col(out) > 0) & (F.col(out) < most))


def density_profile(
    df: DataFrame, keys: list[str], lev: str, rho: str, depth: str, values: list[str], grid: Grid, least: float = 0.2, dz: str | None = None
) -> DataFrame:
    """Whole re-indexing of columns: sub-profile, interpolation, bottom bin, thickness.

    One pass: each pair of levels makes its range of bins and the densest level the bottom bin in the same explode. With dz, the levels'
    thickness, half of the densest level's is added to the bottom's depth, so that the column keeps its whole thickness. Bins are numbered from
    1: what is lighter than the grid's first level ends in the depth of bin 0, which has no row of its own.
    """
    names = [depth, *values]
    df = sub_profile(df, keys, lev, rho, least)
    w = Window.partitionBy(*keys).orderBy(lev)
    densest = F.max(F.struct(F.col(rho), F.col(lev))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nexts = [F.lead(v).over(w).alias(f"_next_{v}") for v in (rho, *names)]
    rows = df.select(*keys, lev, rho, *names, *([dz] if dz else []), *nexts, densest.alias("_d"))
    first = F.greatest(grid.first_at_or_above(F.col(rho)), F.lit(0))
    last = F.least(grid.first_at_or_above(F.col(f"_next_{rho}")) - 1, F.lit(grid.size - 1))
    # the densest level begins no pair, as what follows isn't denser, and its bin is above the bins of all pairs: a row makes either kind, a bin has one kind
    is_bottom = (F.col(rho) == F.col(f"_d.{rho}")) & (F.col(lev) == F.col(f"_d.{lev}"))
    end = F.when(is_bottom, F.when(first < grid.size, first)).when(F.col(f"_next_{rho}") > F.col(rho), last)
    rows = rows.withColumn("_bottom", is_bottom).withColumn("_a", first).withColumn("_b", end).where("_a <= _b").withColumn("rho_idx", F.explode(F.sequence("_a", "_b")))
    share = (grid.value(F.col("rho_idx")) - F.col(rho)) / (F.col(f"_next_{rho}") - F.col(rho))
    whole = {v: F.col(v) for v in names} | ({depth: F.col(depth) + F.col(dz) / 2} if dz else {})
    at = [F.when(F.col("_bottom"), whole[v]).otherwise(F.col(v) + share * (F.col(f"_next_{v}") - F.col(v))).alias(v) for v in names]
    # of several pairs the deepest
    rows = rows.select(*keys, lev, "rho_idx", *at).groupBy(*keys, "rho_idx").agg(F.max_by(F.struct(*names), F.col(lev)).alias("_v"))
    rows = bin_thickness(rows.select(*keys, "rho_idx", *(F.col(f"_v.{v}").alias(v) for v in names)), keys, depth)
    return rows.where("rho_idx > 0")


def flux_on_density(df: DataFrame, keys: list[str], lev: str, rho: str, depth: str, amount: Column, grid: Grid, least: float = 0.2, out: str = "flux") -> DataFrame:
    """Bins of each column with their depth, thickness and share of an extensive amount per level (thickness times velocity).

    The amount below each level is interpolated to the bins and differenced; the lightest bin takes all above it and the densest all that is left, so
    the column's total is conserved.
    """
    df = from_bottom(df, keys, lev, amount, "_below")
    total = F.first("_below").over(Window.partitionBy(*keys).orderBy(lev).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = density_profile(df.withColumn("_total", total), keys, lev, rho, depth, ["_below", "_total"], grid, least)
    w = Window.partitionBy(*keys).orderBy("rho_idx")
    above = F.coalesce(F.lag("_below").over(w), F.col("_total"))
    below = F.when(F.lead("rho_idx").over(w).isNotNull(), F.col("_below")).otherwise(0.0)
    return rows.select(*keys, "rho_idx", depth, "thick", (above - below).alias(out))


def conservation(before: DataFrame, after: DataFrame, keys: list[str], amounts: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Sums of amounts per key in two tables: <amount>_before, <amount>_after, and kept: whether all agree within a relative tolerance.

    A key that only one table has is not kept.
    """
    sums = lambda df, tail: df.groupBy(*keys).agg(*(F.sum(a).alias(a + tail) for a in amounts))
    rows = sums(before, "_before").join(sums(after, "_after"), keys, "full")
    same = F.lit(True)
    for a in amounts:
        x, y = F.col(a + "_before"), F.col(a + "_after")
        same = same & F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1.0)), F.lit(False))
    return rows.withColumn("kept", same)


def volume_means(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], weights: tuple[str, str]) -> DataFrame:
    """Volume-weighted means of values per key in two tables (<value>_before, <value>_after) and their difference (<value>_drift): what a change of
    coordinate does to mean temperature and salinity. weights: the columns of volume; rows without a value or a volume don't count."""
    def means(df: DataFrame, weight: str, tail: str) -> DataFrame:
        w = F.col(weight)
        return df.groupBy(*keys).agg(*(F.try_divide(F.sum(F.col(v) * w), F.sum(F.when(F.col(v).isNotNull(), w))).alias(v + tail) for v in values))

    rows = means(before, weights[0], "_before").join(means(after, weights[1], "_after"), keys, "full")
    return rows.withColumns({f"{v}_drift": F.col(f"{v}_after") - F.col(f"{v}_before") for v in values})


def bowl_layers(
    df: DataFrame, keys: list[str], rho: str, z: str, content: str, volume: str, edges: list[float], bowl_depth: float, offset: float = 0.0,
) -> DataFrame:
    """content_layers() with each column's own edge at the bowl, the density that its profile has at bowl_depth: (keys, layer, below, content, volume,
    spice, anomaly).

    The density is interpolated between the two levels around that depth (the nearest level's beyond the ends). Each layer between the density interfaces is cut by
    it into a part above and one below the bowl (`below`). spice is the content minus the volume-weighted mean of the same layer part over
    all columns, anomaly minus that of the whole domain.
    """
    at = Window.partitionBy(*keys)
    rows = df.where(F.col(rho).isNotNull())
    point = lambda c: F.when(c, F.struct(F.col(z).alias("z"), F.col(rho).alias("r")))
    a, b = F.max(point(F.col(z) <= bowl_depth)).over(at), F.min(point(F.col(z) >= bowl_depth)).over(at)
    rows = rows.withColumn("_a", a).withColumn("_b", b)
    share = F.coalesce((bowl_depth - F.col("_a.z")) / F.nullif(F.col("_b.z") - F.col("_a.z"), F.lit(0.0)), F.lit(0.0))
    bowl = F.coalesce(F.col("_a.r") + share * (F.col("_b.r") - F.col("_a.r")), F.col("_a.r"), F.col("_b.r"))
    layer = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col(rho)))
    rows = rows.where(F.col(content).isNotNull() & (F.col(volume) > 0)).withColumn("layer", layer).withColumn("below", F.col(rho) >= bowl)
    amount = F.sum(F.col(content) * F.col(volume)).alias("_c")
    parts = rows.groupBy(*keys, "layer", "below").agg(amount, F.sum(volume).alias(volume))
    # means of layers and of the domain from the parts' sums: two rows per interface, and one
    layers = parts.groupBy("layer", "below").agg(F.sum("_c").alias("_lc"), F.sum(volume).alias("_lv"))
    whole = layers.agg(F.sum("_lc").alias("_wc"), F.sum("_lv").alias("_wv"))
    parts = parts.join(F.broadcast(layers), ["layer", "below"]).crossJoin(F.broadcast(whole))
    own = F.col("_c") / F.col(volume)
    return parts.select(*keys, "layer", "below", (own + offset).alias(content), volume, (own - F.col("_lc") / F.col("_lv")).alias("spice"), (own - F.col("_wc") / F.col("_wv")).alias("anomaly"))


def content_layers(df: DataFrame, keys: list[str], rho: str, content: str, volume: str, edges: list[float], offset: float = 0.0) -> DataFrame:
    """Volume and volume-weighted mean content (plus an offset) in the layers between density interfaces: layer 0 is lighter than the first, layer i
    is [edge i - 1, edge i), the last has what is densest."""
    layer = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col(rho)))
    rows = df.where(F.col(rho).isNotNull() & F.col(content).isNotNull() & (F.col(volume) > 0)).withColumn("layer", layer)
    mean = F.sum(F.col(content) * F.col(volume)) / F.sum(volume) + offset
    return rows.groupBy(*keys, "layer").agg(mean.alias(content), F.sum(volume).alias(volume))


def layer_heights(df: DataFrame, keys: list[str], depth: str, bottom: str, area: str) -> DataFrame:
    """Height and volume of the layers between neighbouring isopycnals (rho_idx is the upper one's): a layer without a lower isopycnal ends at the bottom, one
    without an upper begins at the surface."""
    w = Window.partitionBy(*keys).orderBy("rho_idx")
    low, up = F.lead(depth).over(w), F.col(depth)
    height = F.coalesce(low, F.when(up.isNotNull(), F.col(bottom))) - F.coalesce(up, F.lit(0.0))
    return df.withColumn("height", height).withColumn("volume", F.col("height") * F.col(area)).where("height IS NOT NULL")


def from_bottom(df: DataFrame, keys: list[str], lev: str, amount: Column, out: str) -> DataFrame:
    """Sum of an amount from each level to the column's end."""
    w = Window.partitionBy(*keys).orderBy(lev).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn(out, F.sum(amount).over(w))


def without_drift(df: DataFrame, drift: DataFrame, mean: DataFrame, keys: list[str], year: str, values: list[str], branch: int = 0) -> DataFrame:
    """value - drift(year - branch) + mean state, joined by keys; rows without a drift keep their values."""
    d = drift.select(*keys, (F.col(year) + branch).alias(year), *(F.col(v).alias(f"_d_{v}") for v in values))
    m = mean.select(*keys, *(F.col(v).alias(f"_m_{v}") for v in values))
    out = df.join(d, [*keys, year], "left").join(m, keys, "left")
    fixed = {v: F.col(v) - F.coalesce(F.col(f"_d_{v}") - F.col(f"_m_{v}"), F.lit(0.0)) for v in values}
    return out.withColumns(fixed).drop(*(f"_d_{v}" for v in values), *(f"_m_{v}" for v in values))


def at_levels(df: DataFrame, keys: list[str], x: str, values: list[str], targets: DataFrame, target: str, outside: str = "null", carry: tuple[str, ...] = ()) -> DataFrame:
    """Linear interpolation of values over x at the rows of targets (keys, target); outside the range null, 0, or the nearest value
    (outside="null", "zero", "edge"). Points and targets meet in one sorted window, so no range join is made. Columns of targets in `carry` come along."""
    kinds = {c: targets.schema[c].dataType for c in carry}
    points = df.where(F.col(x).isNotNull()).select(*keys, *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()), F.col(x).alias("_x"), *(F.when(F.lit(True), F.struct(F.col(x).alias("x"), F.col(v).alias("v"))).alias(v) for v in values), F.lit(0).alias("_t"))
    asked = targets.select(*keys, *carry, F.col(target).alias("_x"), *(F.lit(None).cast(points.schema[v].dataType).alias(v) for v in values), F.lit(1).alias("_t"))
    both = points.unionByName(asked)
    up = Window.partitionBy(*keys).orderBy("_x", "_t").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.col("_x").desc(), "_t").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("*", *(F.last(v, True).over(up).alias(f"_a_{v}") for v in values), *(F.last(v, True).over(down).alias(f"_b_{v}") for v in values))

    def value(v: str) -> Column:
        a, b = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        line = F.when(a["x"] == b["x"], a["v"]).otherwise(a["v"] + (F.col("_x") - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)) * (b["v"] - a["v"]))
        rest = {"null": F.lit(None).cast("double"), "zero": F.lit(0.0), "edge": F.coalesce(a["v"], b["v"])}[outside]
        return F.when(a.isNotNull() & b.isNotNull(), line).otherwise(rest)

    return both.where("_t = 1").select(*keys, *carry, F.col("_x").alias(target), *(value(v).alias(v) for v in values))
