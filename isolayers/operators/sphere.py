"""Nearest cells on the sphere by a hierarchy of cubes."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("_x", "_y", "_z")


def unit_points(df: DataFrame, name: str) -> DataFrame:
    """(name, _x, _y, _z): the cells (cell, lat, lon in degrees) as points on the unit sphere."""
    y, x = F.radians("lat"), F.radians("lon")
    return df.select(F.col("cell").alias(name), (F.cos(y) * F.cos(x)).alias("_x"), (F.cos(y) * F.sin(x)).alias("_y"), F.sin(y).alias("_z"))


def _cube(level: Column) -> list[Column]:
    """Indices of a point's cube at a level, where the space around the sphere is 2**level cubes long."""
    return [F.floor((F.col(c) + 1.0) / (2.0 / F.pow(F.lit(2.0), level))).alias(f"_c{c}") for c in AXES]


def _around() -> Column:
    return F.explode(F.array(*(F.struct(*(F.lit(d).alias(c) for d, c in zip(ds, AXES))) for ds in itertools.product((-1, 0, 1), repeat=3))))


def nearest_cells(source: DataFrame, target: DataFrame, nearest: int = 4, levels: int = 12) -> DataFrame:
    """(dst_cell, src_cell, arc, rank): the `nearest` source cells of each target cell and their distances in radians; of equally near ones the lower
    cell comes first. source and target: (cell, lat, lon in degrees).

    Sources are counted by cube at each of the levels, and each cube takes the counts of its 26 neighbours. A target takes the finest level
    at which that is `nearest` or more: its nearest ones then lie within 2 * sqrt(3) cube lengths, and two levels up the cubes around it hold all that is so
    near. So whatever the density of the sources, one join with the counts and one with the sources find the true nearest cells; a target for
    which no cube counts enough looks at all of the few sources. Sources much denser than those near a target, but no further than some eight times
    its distance from them, are compared too. `levels` says how fine cubes get: 12 is 3 km.

    Of source cells at one place (lat, lon) the `nearest` lowest are compared. The joins are merges: Spark takes the exploded sides for as small as
    their files, and would broadcast them through the driver.
    """
    order = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("cell"))
    few = source.select("cell", "lat", "lon", order.alias("_n")).where(F.col("_n") <= nearest)
    s, t = unit_points(few, "src_cell"), unit_points(target, "dst_cell")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level")
    cubes = ["_level", *(f"_c{c}" for c in AXES)]
    placed = s.select("*", level).select("src_cell", *AXES, "_level", *_cube(F.col("_level")))
    counts = placed.groupBy(*cubes).agg(F.count(F.lit(1)).alias("n"))
    spread = counts.select("_level", *(f"_c{c}" for c in AXES), "n", _around().alias("_d")).select("_level", *((F.col(f"_c{c}") + F.col(f"_d.{c}")).alias(f"_c{c}") for c in AXES), "n")
    enough = spread.groupBy(*cubes).agg(F.sum("n").alias("n")).where(F.col("n") >= nearest).select(*cubes)
    own = t.select("*", level).select("dst_cell", "_level", *_cube(F.col("_level")))
    finest = own.join(enough.hint("merge"), cubes).groupBy("dst_cell").agg(F.max("_level").alias("_fine"))
    asked = t.join(finest.hint("merge"), "dst_cell", "left").withColumn("_level", F.greatest(F.coalesce("_fine", F.lit(0)) - 2, F.lit(0)))
    within = F.when(F.col("_fine") >= 2, 2 * 3**0.5 * 2.0 / F.pow(F.lit(2.0), F.col("_fine"))).otherwise(F.lit(2.0))
    asked = asked.select("dst_cell", *(F.col(c).alias(f"{c}t") for c in AXES), *AXES, "_level", within.alias("_within"))
    asked = asked.select("dst_cell", *(f"{c}t" for c in AXES), "_level", "_within", *_cube(F.col("_level")), _around().alias("_d"))
    asked = asked.select("dst_cell", *(f"{c}t" for c in AXES), "_level", "_within", *((F.col(f"_c{c}") + F.col(f"_d.{c}")).alias(f"_c{c}") for c in AXES))
    chord = F.sqrt(sum(((F.col(c) - F.col(f"{c}t")) ** 2 for c in AXES), F.lit(0.0)))
    rows = asked.join(placed.hint("merge"), cubes).withColumn("_d", F.round(chord, 12)).where(F.col("_d") <= F.col("_within") + 1e-9)
    rank = F.row_number().over(Window.partitionBy("dst_cell").orderBy("_d", "src_cell"))
    rows = rows.select("dst_cell", "src_cell", "_d", rank.alias("rank")).where(F.col("rank") <= nearest)
    return rows.select("dst_cell", "src_cell", (2 * F.asin(F.least(F.col("_d") / 2, F.lit(1.0)))).alias("arc"), "rank")


def nearest_by_place(source: DataFrame, target: DataFrame, nearest: int = 4, levels: int = 12) -> DataFrame:
    """nearest_cells() with each place of targets asked once, for targets of which many share a place (lat, lon)."""
    places = target.select("lat", "lon").distinct().select(F.struct("lat", "lon").alias("cell"), "lat", "lon")
    found = nearest_cells(source, places, nearest, levels).withColumnRenamed("dst_cell", "_place")
    rows = target.select(F.col("cell").alias("dst_cell"), F.struct("lat", "lon").alias("_place"))
    return rows.join(found.hint("merge"), "_place").select("dst_cell", "src_cell", "arc", "rank")


def inverse_distance_weights(source: DataFrame, target: DataFrame, nearest: int = 4, levels: int = 12) -> DataFrame:
    """(src_cell, dst_cell, weight) of the nearest source cells of each target cell, weighted by the inverse of their distance; see nearest_cells()."""
    rows = nearest_by_place(source, target, nearest, levels).withColumn("_w", 1 / (F.col("arc") + 1e-9))
    return rows.select("src_cell", "dst_cell", (F.col("_w") / F.sum("_w").over(Window.partitionBy("dst_cell"))).alias("weight"))
