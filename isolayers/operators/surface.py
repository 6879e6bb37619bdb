"""Surface water-mass transformation: density fluxes summed over outcrops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.density_grid import SURFACE, Grid
from .repair import short


def outcrop_transformation(df: DataFrame, keys: list[str], rho: str, fluxes: list[str], area: str, grid: Grid = SURFACE, scale: float = 1e-6) -> DataFrame:
    """Per bin [level, next): sum of flux * area over the bin's width, and the outcrop's area. Densities beyond the last level fall
    into the last bin; those lighter than the grid and nulls are left out."""
    at = F.when(F.col(rho) >= grid.high, grid.size - 1).otherwise(grid.bin(F.col(rho)))
    # rows outside the grid are a group that goes afterwards, told by an aggregate: a filter on the index would be pushed into the
    # scan, and with it the whole density polynomial, once for each mention
    sums = df.withColumn("rho_idx", at).groupBy(*keys, "rho_idx").agg(*(F.sum(F.col(f) * F.col(area)).alias(f) for f in fluxes), F.sum(area).alias("area"), F.count("rho_idx").alias("_n"))
    return sums.where("_n > 0").drop("_n").withColumns({f: F.col(f) / grid.step(F.col("rho_idx")) * scale for f in fluxes})


def formation(df: DataFrame, keys: list[str], flux: str, out: str = "formation") -> DataFrame:
    """Minus the difference of the transformation to the next bin; null at the last and where the next bin has no outcrop."""
    w = Window.partitionBy(*keys).orderBy("rho_idx")
    next_bin = F.lead("rho_idx").over(w) == F.col("rho_idx") + 1
    return df.withColumn(out, F.when(next_bin, F.col(flux) - F.lead(flux).over(w)))


def in_regions(df: DataFrame, regions: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows once for each region they lie in. regions: (region, latmin, latmax, lonmin, lonmax), a short list that is broadcast; a region with
    lonmin > lonmax reaches over the date line; upper limits are excluded."""
    y, x = F.col(lat), F.col(lon)
    inside = (y >= F.col("latmin")) & (y < F.col("latmax"))
    east, west = x >= F.col("lonmin"), x < F.col("lonmax")
    inside = inside & F.when(F.col("lonmin") <= F.col("lonmax"), east & west).otherwise(east | west)
    return df.join(short(regions), inside).drop("latmin", "latmax", "lonmin", "lonmax")


def season(month: Column) -> Column:
    """DJF, MAM, JJA or SON of a month from 1 to 12."""
    names = F.array(*(F.lit(n) for n in ("DJF", "MAM", "JJA", "SON")))
    return F.element_at(names, (F.floor(F.pmod(month, F.lit(12)) / 3) + 1).cast("int"))


def run_difference(run: DataFrame, control: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """run minus control per key; what only one of them has counts as 0 in the other."""
    other = control.select(*keys, *(F.col(v).alias(f"_c_{v}") for v in values))
    both = run.select(*keys, *values).join(other, keys, "full")
    return both.select(*keys, *((F.coalesce(F.col(v), F.lit(0.0)) - F.coalesce(F.col(f"_c_{v}"), F.lit(0.0))).alias(v) for v in values))


def domain_integrals(df: DataFrame, keys: list[str], lat: str, flux: str, area: str, factor: float = 1.0) -> DataFrame:
    """Sums of flux * area for the domains global, north (> 0), north40 (> 40) and south (< 0); one row per domain that has cells."""
    y = F.col(lat)
    inside: dict[str, Column] = {"global": F.lit(True), "north": y > 0, "north40": y > 40, "south": y < 0}
    domains = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in inside.items())))
    return df.withColumn("domain", F.explode(domains)).groupBy(*keys, "domain").agg((F.sum(F.col(flux) * F.col(area)) * factor).alias(flux))
