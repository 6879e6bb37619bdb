"""Cleaning and repair of gridded fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a list that is broadcast.
SHORT = 10_000


def short(df: DataFrame, most: int = SHORT) -> DataFrame:
    """df to be broadcast, once it is known to have at most `most` rows; a longer one is an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a list of more than {most} rows is no short list; join it by a key")
    return F.broadcast(df)


def mask_to_null(x: Column, missing: float = 1e20) -> Column:
    """NaN and what is as far out as a tenth of the missing value become null."""
    beyond = x > missing / 10 if missing > 0 else x < missing / 10
    return F.when(~(F.isnan(x) | beyond), x)


def recoded(x: Column, old: float) -> Column:
    """Another sentinel becomes null."""
    return F.when(x != old, x)


def salinity_mask(df: DataFrame, salt: str, others: list[str]) -> DataFrame:
    """Salinity 0 is missing, and where salinity is missing so are the others."""
    s = F.when(F.col(salt) != 0, F.col(salt))
    return df.withColumns({salt: s, **{o: F.when(s.isNotNull(), F.col(o)) for o in others}})


def kelvin_repaired(df: DataFrame, dataset: list[str], temp: str, least: float = 100.0) -> DataFrame:
    """Datasets whose mean temperature is over `least` are in kelvin and become deg C; the mean comes from a partial aggregate."""
    means = df.groupBy(*dataset).agg((F.avg(temp) > least).alias("_kelvin"))
    return df.join(means, dataset).withColumn(temp, F.when(F.col("_kelvin"), F.col(temp) - 273.15).otherwise(F.col(temp))).drop("_kelvin")


def in_range_datasets(df: DataFrame, dataset: list[str], limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Datasets whose values all lie in the limits."""
    aggs = [a for v in limits for a in (F.min(v).alias(f"_lo_{v}"), F.max(v).alias(f"_hi_{v}"))]
    good = df.groupBy(*dataset).agg(*aggs)
    for v, (lo, hi) in limits.items():
        good = good.where((F.col(f"_lo_{v}") >= lo) & (F.col(f"_hi_{v}") <= hi))
    return good.select(*dataset)


def practical_salinity(absolute: Column) -> Column:
    return absolute * 0.9953


def levels_by_depth(df: DataFrame, keys: list[str], lev: str, z: str) -> DataFrame:
    """Levels numbered from 1 by depth, whatever way the dataset was stored."""
    return df.withColumn(lev, F.row_number().over(Window.partitionBy(*keys).orderBy(z)))


def shapes(df: DataFrame, dataset: list[str], axes: list[str]) -> DataFrame:
    """Rows, and distinct values of each axis, per dataset; compare two tables by a join on it."""
    return df.groupBy(*dataset).agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(a).alias(f"n_{a}") for a in axes))


def compared_shapes(one: DataFrame, two: DataFrame, dataset: list[str], axes: list[str]) -> DataFrame:
    """shapes() of both tables per dataset (n, n_<axis> and the same with _2), and `same`; a dataset that one of them lacks is not the same."""
    names = ["n", *(f"n_{a}" for a in axes)]
    b = shapes(two, dataset, axes).withColumnsRenamed({c: f"{c}_2" for c in names})
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_2"))
    return shapes(one, dataset, axes).join(b, dataset, "full").withColumn("same", same)


def seam_repaired(df: DataFrame, keys: list[str], lon_idx: str, lat_idx: str, value: str, i1: int, i2: int, jmax: int, width: int) -> DataFrame:
    """South of lat index jmax: the value at i1 becomes the mean of its neighbours i1 - 1 and i2 + 1 (0 beyond the last), and i2 takes it."""
    after = 0 if i2 >= width - 1 else i2 + 1
    w = Window.partitionBy(*keys, lat_idx)
    at = lambda i: F.max(F.when(F.col(lon_idx) == i, F.col(value))).over(w)
    return df.withColumn(value, F.when((F.col(lat_idx) < jmax) & F.col(lon_idx).isin(i1, i2), (at(i1 - 1) + at(after)) / 2).otherwise(F.col(value)))


def bowl_repaired(bowl: DataFrame, profile: DataFrame, keys: list[str], salt: str, depth: str, values: list[str], least: float = 30.0) -> DataFrame:
    """Where the bowl's salinity is under `least`, all its values are taken from the shallowest density level (of equal ones the largest)."""
    top = F.min_by(F.struct(depth, *values), F.struct(F.col(depth), *(-F.col(v) for v in values)))
    tops = profile.groupBy(*keys).agg(top.alias("_t"))
    wrong = F.col(salt) < least
    return bowl.join(tops, keys, "left").withColumns({v: F.when(wrong, F.col(f"_t.{v}")).otherwise(F.col(v)) for v in (depth, *values)}).drop("_t")


def basins_simplified(basin: Column, lon: Column, arctic_is_own: bool = False) -> Column:
    """1 Atlantic, 2 Pacific, 3 Indian (4 Arctic if it is its own basin), else null.

    The Southern Ocean (10) is split at 70.5 W, 20.5 E and 147.5 E, upper limits excluded; the Arctic (11) is Atlantic or its own; the Bay of
    Bengal (56) is Indian.
    """
    south = F.when((lon >= -70.5) & (lon < 20.5), 1).when((lon >= 20.5) & (lon < 147.5), 3).otherwise(2)
    return F.when(basin == 10, south).when(basin == 11, 4 if arctic_is_own else 1).when(basin == 56, 3).when(basin.between(1, 3), basin)


def deepest_valid(df: DataFrame, cell: list[str], depth: str, value: str) -> DataFrame:
    return df.groupBy(*cell).agg(F.max(F.when(F.col(value).isNotNull(), F.col(depth))).alias("depth_max"))


def points_corrected(cells: DataFrame, points: DataFrame, basin: str = "basin") -> DataFrame:
    """cells (cell, lat, lon, basin) with the basin `after` at the cell nearest to each listed point (lat, lon, before, after).

    The nearest of all cells is sought; with a `before`, it changes only if that is its basin. Each task finds the nearest of its cells to each point of
    the short list (see short()), so one row per point and task is shuffled.
    """
    p = points.select(F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), F.col("before").alias("_before"), F.col("after").alias("_after"))
    half = lambda a, b: F.sin(F.radians(F.col(a) - F.col(b)) / 2) ** 2
    arc = half("lat", "_plat") + F.cos(F.radians("lat")) * F.cos(F.radians("_plat")) * half("lon", "_plon")
    near = cells.crossJoin(short(p))
    near = near.groupBy("_plat", "_plon", "_before", "_after").agg(F.min_by(F.struct("cell", F.col(basin).alias("_basin")), F.struct(F.round(arc, 15), F.col("cell"))).alias("_c"))
    near = near.where(F.coalesce(F.col("_before") == F.col("_c._basin"), F.col("_before").isNull()))
    fixed = near.groupBy(F.col("_c.cell").alias("cell")).agg(F.min("_after").alias("_new"))
    return cells.join(fixed, "cell", "left").withColumn(basin, F.coalesce("_new", basin)).drop("_new")


def normalised_areas(cells: DataFrame, area: str, earth: float = 510.072e12) -> DataFrame:
    """Areas scaled so that all cells add up to the Earth's area (m2)."""
    total = cells.agg(F.sum(area).alias("_all"))
    return cells.join(F.broadcast(total)).withColumn(area, F.col(area) / F.col("_all") * earth).drop("_all")  # one row


def cell_areas(lats: DataFrame, lons: DataFrame, radius: float = 6371e3) -> DataFrame:
    """(lat, lon, area, scalex, scaley) of the cells of two axes: edges are midpoints, the poles end the first and last latitude, and the first and
    last longitude take their neighbour's width."""
    w, x = Window.orderBy("lat"), Window.orderBy("lon")  # one row per axis point
    south = F.coalesce((F.lag("lat").over(w) + F.col("lat")) / 2, F.lit(-90.0))
    north = F.coalesce((F.lead("lat").over(w) + F.col("lat")) / 2, F.lit(90.0))
    before, after = F.col("lon") - F.lag("lon").over(x), F.lead("lon").over(x) - F.col("lon")
    width = F.coalesce((before + after) / 2, after, before)
    a = lats.select("lat", south.alias("south"), north.alias("north"))
    b = lons.select("lon", width.alias("width"))
    rows = a.crossJoin(F.broadcast(b))
    dx = F.radians("width") * radius
    area = radius * dx * (F.sin(F.radians("north")) - F.sin(F.radians("south")))
    return rows.select("lat", "lon", area.alias("area"), (dx * F.cos(F.radians("south"))).alias("scalex"), (F.radians(F.col("north") - F.col("south")) * radius).alias("scaley"))
