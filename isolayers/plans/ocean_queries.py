"""Queries over the ocean-like fixture and their SQL: columns, bins, persistence, basins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import change, columns, repair, sphere, time_space
from .fixture import ANNUAL, BASIN, BOTTOM, GRID, KEYS, OCEAN, PROFILE, basins, ocean, on_density_sql, place_sql, r4, sub_sql, with_basin

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def profile(spark: SparkSession, d: str, whole_years: bool = False, values: tuple[str, ...] = ("t", "s")) -> DataFrame:
    """Bins with the values that a query uses; all of them are sorted with the bins, as a bin's values are one struct."""
    return columns.density_profile(ocean(spark, d, whole_years=whole_years), KEYS, "lev", "rho", "z", list(values), GRID)


def annual(spark: SparkSession, d: str, values: tuple[str, ...] = ("t", "s")) -> DataFrame:
    return time_space.annual_bins(profile(spark, d, True, values), ["cell", "y", "rho_idx"], "z", list(values), "thick")


def _rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *(r4(v).alias(v) for v in values))


@query(f"WITH {OCEAN} SELECT cell, y, m, lev, round(rho + 1.3e-7, 4)+0 rho FROM o")
def eos_density(spark, d):
    return _rounded(ocean(spark, d), [*KEYS, "lev"], ["rho"])


@query(f"WITH {OCEAN} SELECT i rho_idx, count(*) n FROM (SELECT CAST(floor({place_sql('rho')}) AS INT) i FROM o) WHERE i BETWEEN 0 AND 59 GROUP BY i")
def rho_grid_counts(spark, d):
    rows = ocean(spark, d).select(GRID.bin(F.col("rho")).alias("rho_idx"))
    return rows.groupBy("rho_idx").agg(F.count("rho_idx").alias("n")).where("n > 0")  # what is outside is a group of its own until here


@query(f"""WITH {PROFILE}, {ANNUAL}, {BASIN}, x AS (SELECT y, rho_idx, t, z, basin FROM ann JOIN b ON cell % 25 = lat)
    SELECT y, basin, rho_idx, round(avg(t) + 1.3e-7, 4)+0 t, round(avg(z) + 1.3e-7, 4)+0 z, count(*) n FROM (SELECT * FROM x UNION ALL SELECT y, rho_idx, t, z, 'Global' FROM x) GROUP BY ALL""")
def annual_zonal_bins(spark, d):
    rows = time_space.with_global(with_basin(annual(spark, d, ("t",)), spark, d))
    return rows.groupBy("y", "basin", "rho_idx").agg(r4(F.avg("t")).alias("t"), r4(F.avg("z")).alias("z"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OCEAN} SELECT cell, y, m, lev, coalesce(lead(z) OVER w - z, z - lag(z) OVER w) dz FROM o WINDOW w AS (PARTITION BY cell, y, m ORDER BY lev)""")
def layer_thickness(spark, d):
    return columns.level_thickness(ocean(spark, d), KEYS, "lev", "z").select(*KEYS, "lev", "dz")


@query(f"WITH {OCEAN}, {sub_sql()} SELECT cell, y, m, min(lev) first_lev, max(lev) last_lev, count(*) n FROM sub GROUP BY ALL")
def column_subprofile(spark, d):
    rows = columns.sub_profile(ocean(spark, d), KEYS, "lev", "rho")
    return rows.groupBy(*KEYS).agg(F.min("lev").alias("first_lev"), F.max("lev").alias("last_lev"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {OCEAN}, v AS (SELECT cell, y, m FROM o WHERE lev = 1) SELECT cell, y, m, lev, round(t + 1.3e-7, 4)+0 t FROM o SEMI JOIN v USING (cell, y, m)")
def surface_valid_columns(spark, d):
    return _rounded(columns.valid_columns(ocean(spark, d), KEYS, "lev", "s"), [*KEYS, "lev"], ["t"])


@query(f"WITH {OCEAN}, {on_density_sql('o')} SELECT cell, y, m, rho_idx, round(z + 1.3e-7, 4)+0 z, round(t + 1.3e-7, 4)+0 t, round(s + 1.3e-7, 4)+0 s FROM ins")
def interpolate_on_density(spark, d):
    rows = columns.on_density(ocean(spark, d), KEYS, "lev", "rho", ["z", "t", "s"], GRID)
    return _rounded(rows, [*KEYS, "rho_idx"], ["z", "t", "s"])


@query(f"WITH {OCEAN}, {sub_sql()}, {BOTTOM} SELECT cell, y, m, rho_idx, round(z + 1.3e-7, 4)+0 z, round(t + 1.3e-7, 4)+0 t FROM bot")
def bottom_bin(spark, d):
    rows = columns.sub_profile(ocean(spark, d), KEYS, "lev", "rho")
    return _rounded(columns.bottom_bin(rows, KEYS, "lev", "rho", ["z", "t"], GRID), [*KEYS, "rho_idx"], ["z", "t"])


@query(f"WITH {PROFILE} SELECT cell, y, m, rho_idx, round(z + 1.3e-7, 4)+0 z, round(thick + 1.3e-7, 4)+0 thick, round(t + 1.3e-7, 4)+0 t, round(s + 1.3e-7, 4)+0 s FROM prof")
def density_profile(spark, d):
    return _rounded(profile(spark, d), [*KEYS, "rho_idx"], ["z", "thick", "t", "s"])


@query(f"""WITH {OCEAN} SELECT cell, y, m, lev, round(sum(s*z) OVER (PARTITION BY cell, y, m ORDER BY lev ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 3)+0 below FROM o""")
def vertical_integral_from_bottom(spark, d):
    rows = columns.from_bottom(ocean(spark, d), KEYS, "lev", F.col("s") * F.col("z"), "below")
    return rows.select(*KEYS, "lev", (F.round("below", 3) + F.lit(0.0)).alias("below"))


@query(f"""WITH {OCEAN}, {sub_sql()}, dz AS (SELECT cell, y, m, lev, coalesce(lead(z) OVER w - z, z - lag(z) OVER w) dz FROM o WINDOW w AS (PARTITION BY cell, y, m ORDER BY lev))
    SELECT cell, y, m, round(arg_max(z + dz/2, (rho, lev)), 3)+0 total, true kept FROM sub JOIN dz USING (cell, y, m, lev) GROUP BY ALL HAVING count(dz) > 0 AND arg_max(coalesce(dz, -1), (rho, lev)) >= 0""")
def integral_conservation(spark, d):
    """The bins' thickness against the depth of the lower edge of the densest level, column by column."""
    rows = columns.level_thickness(ocean(spark, d), KEYS, "lev", "z")
    found = columns.density_profile(rows, KEYS, "lev", "rho", "z", ["t"], GRID, dz="dz").withColumnRenamed("thick", "volume")
    sub = columns.sub_profile(rows, KEYS, "lev", "rho")
    whole = sub.groupBy(*KEYS).agg(F.max_by(F.col("z") + F.col("dz") / 2, F.struct("rho", "lev")).alias("volume")).where("volume IS NOT NULL")
    found = found.groupBy(*KEYS).agg(F.sum("volume").alias("volume"))  # columns and not bins travel to the others
    compared = columns.conservation(whole, found.join(whole.select(*KEYS), KEYS, "left_semi"), KEYS, ["volume"])
    return compared.select(*KEYS, (F.round("volume_after", 3) + 0.0).alias("total"), "kept")


@query(f"WITH {PROFILE}, {ANNUAL} SELECT cell, y, rho_idx, round(pers + 1.3e-7, 4)+0 pers FROM ann")
def persistence_pct(spark, d):
    return _rounded(time_space.persistence(profile(spark, d, True, ()), ["cell", "y", "rho_idx"], "thick"), ["cell", "y", "rho_idx"], ["pers"])


_BOWL = f"""{PROFILE}, {ANNUAL}, bi AS (SELECT cell, y, coalesce(min(CASE WHEN pers >= 50 THEN rho_idx END), CASE WHEN max(z) > 300 THEN max(rho_idx) - 1 END) bowl_idx FROM ann GROUP BY cell, y)"""


@query(f"""WITH {_BOWL} SELECT bi.cell, bi.y, bowl_idx, round(z + 1.3e-7, 4)+0 ptop_z, round(t + 1.3e-7, 4)+0 ptop_t, round(s + 1.3e-7, 4)+0 ptop_s
    FROM bi LEFT JOIN ann ON ann.cell = bi.cell AND ann.y = bi.y AND rho_idx = bowl_idx""")
def bowl_values(spark, d):
    # half of the months: this fixture has too few items per column for bins that last all year
    return _rounded(time_space.bowl(annual(spark, d), ["cell", "y"], "pers", "z", ["z", "t", "s"], least=50.0), ["cell", "y", "bowl_idx"], ["ptop_z", "ptop_t", "ptop_s"])


@query(f"WITH {PROFILE}, {ANNUAL} SELECT cell, y, round(sum(pers*thick)/sum(thick) + 1.3e-7, 4)+0 share FROM ann GROUP BY ALL")
def persistent_share(spark, d):
    return _rounded(time_space.persistent_share(annual(spark, d, ()), ["cell", "y"], "pers", "thick"), ["cell", "y"], ["share"])


@query(f"""WITH {PROFILE}, {ANNUAL}, {BASIN}, x AS (SELECT a.*, basin, 1+cell%7 area FROM ann a JOIN b ON cell % 25 = lat),
    c AS (SELECT y, basin, cell, area, coalesce(sum(CASE WHEN pers >= 40 THEN thick END), 0) h, sum(CASE WHEN pers >= 40 THEN t*thick END)/(sum(CASE WHEN pers >= 40 THEN thick END)+1e-4) t FROM x GROUP BY ALL)
    SELECT y, basin, round(sum(h*area), 3)+0 volume, round(sum(t*area)/sum(area) + 1.3e-7, 4)+0 t FROM c GROUP BY ALL""")
def persistent_volume(spark, d):
    rows = with_basin(annual(spark, d, ("t",)), spark, d).withColumn("area", 1 + F.col("cell") % 7)
    found = time_space.persistent_totals(rows, ["cell"], ["y", "basin"], "pers", "thick", "area", ["t"], least=40.0)
    return found.select("y", "basin", (F.round("volume", 3) + 0.0).alias("volume"), r4("t").alias("t"))


@query(f"""WITH {PROFILE}, {ANNUAL}, {BASIN} SELECT y, basin, rho_idx, lat, round(avg(t) + 1.3e-7, 4)+0 t, round(sum(thick*(1+cell%7))*1e-3 + 1.3e-7, 4)+0 volume
    FROM ann JOIN b ON cell % 25 = lat GROUP BY ALL""")
def zonal_mean_volume(spark, d):
    rows = with_basin(annual(spark, d, ("t",)), spark, d).withColumn("v", F.col("thick") * (1 + F.col("cell") % 7))
    return rows.groupBy("y", "basin", "rho_idx", "lat").agg(r4(F.avg("t")).alias("t"), r4(F.sum("v") * 1e-3).alias("volume"))


@query(f"""WITH {BASIN}, x AS (SELECT basin, l_suppkey cell, l_quantity q FROM lineitem JOIN b ON l_suppkey % 25 = lat)
    SELECT coalesce(basin, 'Global') basin, count(DISTINCT cell) cells, sum(q) total FROM x GROUP BY GROUPING SETS ((basin), ())""")
def basin_totals(spark, d):
    from .fixture import table

    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), "l_quantity")
    # per cell first: the copies for Global are made of partial sums
    cells = with_basin(items.groupBy("cell").agg(F.sum("l_quantity").alias("q")), spark, d)
    return time_space.with_global(cells).groupBy("basin").agg(F.count("cell").alias("cells"), F.sum("q").alias("total"))


@query(f"""WITH {OCEAN}, dr AS (SELECT cell, lev, y, avg(t) d FROM o GROUP BY ALL), mn AS (SELECT cell, lev, avg(t) m FROM o GROUP BY ALL)
    SELECT cell, y, o.m, lev, round(t - (d - mn.m) + 1.3e-7, 4)+0 t FROM o JOIN dr USING (cell, lev, y) JOIN mn USING (cell, lev)""")
def drift_removed(spark, d):
    rows = ocean(spark, d)
    drift, mean = rows.groupBy("cell", "lev", "y").agg(F.avg("t").alias("t")), rows.groupBy("cell", "lev").agg(F.avg("t").alias("t"))
    return _rounded(columns.without_drift(rows, drift, mean, ["cell", "lev"], "y", ["t"]), [*KEYS, "lev"], ["t"])


@query(f"WITH {OCEAN} SELECT cell, lev, round(avg(t) FILTER (y BETWEEN 1995 AND 1996) + 1.3e-7, 4)+0 mean1, round(avg(t) FILTER (y BETWEEN 1999 AND 2000) + 1.3e-7, 4)+0 mean2, round(avg(t) FILTER (y BETWEEN 1999 AND 2000) - avg(t) FILTER (y BETWEEN 1995 AND 1996) + 1.3e-7, 4)+0 change FROM o WHERE y BETWEEN 1995 AND 1996 OR y BETWEEN 1999 AND 2000 GROUP BY ALL")
def period_difference(spark, d):
    found = change.period_difference(ocean(spark, d), ["cell", "lev"], "y", "t", (1995, 1996), (1999, 2000))
    return _rounded(found, ["cell", "lev"], ["mean1", "mean2", "change"])


@query(f"""WITH {OCEAN} SELECT cell, y, m, lev, round((lead(s) OVER w - s)/(lead(rho) OVER w - rho) + 1.3e-7, 4)+0 slope FROM o WINDOW w AS (PARTITION BY cell, y, m ORDER BY rho)""")
def derivative_rho(spark, d):
    return _rounded(change.forward_derivative(ocean(spark, d), KEYS, "rho", "s"), [*KEYS, "lev"], ["slope"])


_GRID = f"""{OCEAN}, g AS (SELECT CAST(cell % 25 AS INT) lat, CAST(cell // 25 AS INT) lon, y, lev, avg(s) s, avg(t) t FROM o GROUP BY ALL)"""


def gridded(spark, d):
    lat, lon = (F.col("cell") % 25).cast("int").alias("lat"), F.floor(F.col("cell") / 25).cast("int").alias("lon")
    return ocean(spark, d).groupBy(lat, lon, "y", "lev").agg(F.avg("s").alias("s"), F.avg("t").alias("t"))


@query(f"""WITH {_GRID} SELECT lat, lon, y, lev, round((lead(s) OVER w - s)/(lead(lat) OVER w - lat) + 1.3e-7, 4)+0 slope FROM g WINDOW w AS (PARTITION BY lon, y, lev ORDER BY lat)""")
def derivative_lat(spark, d):
    return _rounded(change.forward_derivative(gridded(spark, d), ["lon", "y", "lev"], "lat", "s"), ["lat", "lon", "y", "lev"], ["slope"])


@query(f"WITH {_GRID} SELECT lat, lon, y, lev, round(s - avg(s) OVER (PARTITION BY lat, y, lev) + 1.3e-7, 4)+0 anomaly FROM g")
def zonal_anomaly(spark, d):
    return _rounded(change.without_mean(gridded(spark, d), ["lat", "y", "lev"], "s"), ["lat", "lon", "y", "lev"], ["anomaly"])


@query(f"""WITH {OCEAN}, x AS (SELECT cell, lev, avg(t) FILTER (y >= 1999) - avg(t) FILTER (y <= 1996) c, stddev_pop(t) e FROM o GROUP BY ALL)
    SELECT cell, lev, CASE WHEN abs(c) >= 1.1*1.64*(e/10) THEN 1 ELSE 0 END significant FROM x WHERE c IS NOT NULL""")
def significance_flag(spark, d):
    mean = lambda c: F.avg(F.when(c, F.col("t")))
    rows = ocean(spark, d).groupBy("cell", "lev").agg((mean(F.col("y") >= 1999) - mean(F.col("y") <= 1996)).alias("c"), F.stddev_pop("t").alias("e")).where("c IS NOT NULL")
    return rows.select("cell", "lev", change.significant(F.col("c"), F.col("e") / 10).alias("significant"))


@query(f"WITH {PROFILE}, {ANNUAL} SELECT cell, y, min(rho_idx) bowl FROM ann GROUP BY ALL")
def bowl_from_data(spark, d):
    return change.bowl_from_data(annual(spark, d, ("t",)), ["cell", "y"], "rho_idx", "t")


@query(f"WITH {PROFILE} SELECT cell, y, m, arg_min(rho_idx, (abs(rho_idx - 30), rho_idx)) rho_idx, round(arg_min(t, (abs(rho_idx - 30), rho_idx)) + 1.3e-7, 4)+0 t FROM prof GROUP BY ALL")
def isopycnal_slice(spark, d):
    return _rounded(change.nearest(profile(spark, d, values=("t",)), KEYS, "rho_idx", F.lit(30), ["t"]), [*KEYS, "rho_idx"], ["t"])


@query(f"WITH {_GRID} SELECT lon, y, lev, round(sum(s*cos(radians(lat)))/sum(cos(radians(lat))) + 1.3e-7, 4)+0 s FROM g WHERE lat BETWEEN 5 AND 15 GROUP BY ALL")
def section_coslat(spark, d):
    return _rounded(change.cosine_section(gridded(spark, d), ["lon", "y", "lev"], "lat", "s", 5, 15), ["lon", "y", "lev"], ["s"])


@query(f"WITH {_GRID} SELECT lat, y, lev, round(avg(CASE WHEN t > 25 THEN 0 ELSE t END) + 1.3e-7, 4)+0 t FROM g GROUP BY ALL")
def section_capped(spark, d):
    return _rounded(change.capped_section(gridded(spark, d), ["lat", "y", "lev"], "t", 25.0), ["lat", "y", "lev"], ["t"])


_MIGRATE = f"""{OCEAN}, f AS (SELECT CAST(cell // 25 AS INT) lon, CAST(cell % 25 AS INT) lat, lev*0.25e0 r, avg(s) FILTER (y <= 1997) x1, avg(s) FILTER (y >= 1999) x2 FROM o GROUP BY ALL),
    mg AS (SELECT a.lon, a.lat, a.r, arg_min(a.lat - c.lat, ((a.lat-c.lat)**2+(a.r-c.r)**2, c.lat, c.r)) d_lat, arg_min(a.r - c.r, ((a.lat-c.lat)**2+(a.r-c.r)**2, c.lat, c.r)) d_rho
      FROM f a JOIN f c ON a.lon = c.lon AND abs(a.x1 - c.x2) < 0.02e0*(1 - 1e-9) AND abs(a.lat - c.lat) < 5 AND abs(a.r - c.r) < 0.5 GROUP BY ALL)"""


@query(f"WITH {_MIGRATE} SELECT lon, lat, r, CAST(d_lat AS INT) d_lat, d_rho FROM mg")
def migration_nearest(spark, d):
    return change.migration(_migrating(spark, d), ["lon"], "lat", "r", "x1", "x2", 0.02)


def _migrating(spark, d):
    lon, lat = F.floor(F.col("cell") / 25).cast("int").alias("lon"), (F.col("cell") % 25).cast("int").alias("lat")
    mean = lambda c: F.avg(F.when(c, F.col("s")))
    return ocean(spark, d).groupBy(lon, lat, (F.col("lev") * 0.25).alias("r")).agg(mean(F.col("y") <= 1997).alias("x1"), mean(F.col("y") >= 1999).alias("x2"))


@query(f"""WITH {_MIGRATE}, sl AS (SELECT lon, lat, r, x2 - x1 c, lead(x1) OVER (PARTITION BY lon, r ORDER BY lat) - x1 dy, (lead(x1) OVER (PARTITION BY lon, lat ORDER BY r) - x1)/(lead(r) OVER (PARTITION BY lon, lat ORDER BY r) - r) dr,
      lead(lat) OVER (PARTITION BY lon, r ORDER BY lat) - lat st FROM f)
    SELECT lon, lat, r, round(dy/st*d_lat + dr*d_rho + 1.3e-7, 4)+0 moved, round(c - (dy/st*d_lat + dr*d_rho) + 1.3e-7, 4)+0 residual FROM sl JOIN mg USING (lon, lat, r)""")
def migration_residual(spark, d):
    field = _migrating(spark, d)
    slopes = change.forward_derivative(change.forward_derivative(field, ["lon", "r"], "lat", "x1", "dy"), ["lon", "lat"], "r", "x1", "dr")
    rows = slopes.join(change.migration(field, ["lon"], "lat", "r", "x1", "x2", 0.02), ["lon", "lat", "r"])
    moved = F.col("dy") * F.col("d_lat") + F.col("dr") * F.col("d_rho")
    return rows.select("lon", "lat", "r", r4(moved).alias("moved"), r4(F.col("x2") - F.col("x1") - moved).alias("residual"))


@query(f"""WITH {PROFILE}, {ANNUAL}, x AS (SELECT *, CASE WHEN z < 100 THEN 0 WHEN z < 300 THEN 1 WHEN z < 1000 THEN 2 WHEN z < 3000 THEN 3 END zi FROM ann WHERE thick > 0)
    SELECT cell, y, CAST(zi AS INT) z_idx, round(sum(t*thick)/sum(thick) + 1.3e-7, 4)+0 t, round(sum(thick) + 1.3e-7, 4)+0 thick FROM x WHERE zi IS NOT NULL GROUP BY ALL""")
def remap_to_z(spark, d):
    return _rounded(change.remap_to_depth(annual(spark, d, ("t",)), ["cell", "y"], "z", "thick", "t", [0, 100, 300, 1000, 3000]), ["cell", "y", "z_idx"], ["t", "thick"])


@query(f"""WITH {OCEAN}, g0 AS (SELECT cell, y, lev, z, avg(t) t FROM o GROUP BY ALL), g AS (SELECT cell, y, lev, z, CASE WHEN lev % 3 <> 0 THEN t END t FROM g0),
    k AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN z END IGNORE NULLS) OVER a za, last_value(t IGNORE NULLS) OVER a ta, first_value(CASE WHEN t IS NOT NULL THEN z END IGNORE NULLS) OVER c zb, first_value(t IGNORE NULLS) OVER c tb
      FROM g WINDOW a AS (PARTITION BY cell, y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY cell, y ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT cell, y, lev, round(coalesce(t, ta+(z-za)/nullif(zb-za, 0)*(tb-ta)) + 1.3e-7, 4)+0 filled FROM k""")
def gap_fill_linear(spark, d):
    rows = ocean(spark, d).groupBy("cell", "y", "lev", "z").agg(F.avg("t").alias("t")).withColumn("t", F.when(F.col("lev") % 3 != 0, F.col("t")))
    return _rounded(change.gaps_filled(rows, ["cell", "y"], "z", "t"), ["cell", "y", "lev"], ["filled"])


@query(f"""WITH {OCEAN}, g AS (SELECT CAST(cell // 25 AS INT) lon, CAST(cell % 25 AS INT) lat, y, lev, avg(t) v FROM o GROUP BY ALL),
    x AS (SELECT *, max(CASE WHEN lat = 9 THEN v END) OVER w v1, max(CASE WHEN lat = 12 THEN v END) OVER w v2 FROM g WINDOW w AS (PARTITION BY lon, y, lev))
    SELECT lon, lat, y, lev, round(CASE WHEN lat IN (10, 11) AND lon < 3 THEN (v1+v2)/2 ELSE v END + 1.3e-7, 4)+0 v FROM x""")
def seam_repair(spark, d):
    rows = gridded(spark, d).withColumnRenamed("t", "v")  # latitude stands for the longitude index here
    return _rounded(repair.seam_repaired(rows, ["y", "lev"], "lat", "lon", "v", 10, 11, 3, 25), ["lon", "lat", "y", "lev"], ["v"])


@query(f"""WITH {PROFILE}, {ANNUAL}, bi AS (SELECT cell, y, arg_max(z, rho_idx) z, arg_max(s, rho_idx) s, arg_max(t, rho_idx) t FROM ann GROUP BY ALL),
    tp AS (SELECT cell, y, arg_min(z, (z, -s, -t)) z1, arg_min(s, (z, -s, -t)) s1, arg_min(t, (z, -s, -t)) t1 FROM ann GROUP BY ALL)
    SELECT cell, y, round(CASE WHEN s < 34.9 THEN z1 ELSE z END + 1.3e-7, 4)+0 z, round(CASE WHEN s < 34.9 THEN s1 ELSE s END + 1.3e-7, 4)+0 s, round(CASE WHEN s < 34.9 THEN t1 ELSE t END + 1.3e-7, 4)+0 t FROM bi JOIN tp USING (cell, y)""")
def bowl_repair(spark, d):
    rows = annual(spark, d)
    at = F.max_by(F.struct("z", "s", "t"), "rho_idx")
    bowl = rows.groupBy("cell", "y").agg(at.alias("b")).select("cell", "y", "b.*")
    return _rounded(repair.bowl_repaired(bowl, rows, ["cell", "y"], "s", "z", ["s", "t"], 34.9), ["cell", "y"], ["z", "s", "t"])


@query(f"""WITH {OCEAN}, x AS (SELECT cell, y, m, lev, CASE WHEN m = 6 THEN 'NaN'::DOUBLE WHEN m = 7 THEN 1e20 ELSE t END t FROM o)
    SELECT cell, y, m, lev, round(CASE WHEN m IN (6, 7) THEN NULL ELSE t END + 1.3e-7, 4)+0 t FROM x""")
def mask_to_null(spark, d):
    dirty = F.when(F.col("m") == 6, float("nan")).when(F.col("m") == 7, 1e20).otherwise(F.col("t"))
    return _rounded(ocean(spark, d).withColumn("t", repair.mask_to_null(dirty)), [*KEYS, "lev"], ["t"])


@query(f"""WITH {OCEAN}, x AS (SELECT cell, y, m, lev, t + CASE WHEN cell % 2 = 0 THEN 273.15 ELSE 0 END t FROM o), k AS (SELECT cell, avg(t) > 100 kelvin FROM x GROUP BY cell)
    SELECT cell, y, m, lev, round(CASE WHEN kelvin THEN t - 273.15 ELSE t END + 1.3e-7, 4)+0 t FROM x JOIN k USING (cell)""")
def unit_repair(spark, d):
    rows = ocean(spark, d).withColumn("t", F.col("t") + F.when(F.col("cell") % 2 == 0, 273.15).otherwise(0.0))
    return _rounded(repair.kelvin_repaired(rows, ["cell"], "t"), [*KEYS, "lev"], ["t"])


@query(f"""WITH {OCEAN} SELECT cell, y, m, lev, round(CASE WHEN lev <> 4 THEN s END + 1.3e-7, 4)+0 s, round(CASE WHEN lev <> 4 THEN t END + 1.3e-7, 4)+0 t FROM o""")
def salinity_mask(spark, d):
    rows = ocean(spark, d).withColumn("s", F.when(F.col("lev") == 4, 0.0).otherwise(F.col("s")))
    return _rounded(repair.salinity_mask(rows, "s", ["t"]), [*KEYS, "lev"], ["s", "t"])


@query(f"WITH {OCEAN} SELECT cell FROM o GROUP BY cell HAVING min(t) >= 5.03 AND max(t) <= 31 AND min(s) >= -1 AND max(s) <= 150")
def range_validation(spark, d):
    return repair.in_range_datasets(ocean(spark, d), ["cell"], {"t": (5.03, 31.0), "s": (-1.0, 150.0)})


@query(f"WITH {OCEAN} SELECT cell, max(z) depth_max FROM o GROUP BY cell")
def deepest_valid(spark, d):
    return repair.deepest_valid(ocean(spark, d), ["cell"], "z", "t")


@query(f"""WITH {OCEAN}, r AS (SELECT cell, y, m FROM o GROUP BY ALL), k AS (SELECT cell, y FROM r GROUP BY ALL HAVING count(DISTINCT m) = 12)
    SELECT cell, y, count(*) n FROM o SEMI JOIN k USING (cell, y) GROUP BY ALL""")
def complete_years(spark, d):
    return time_space.complete_years(ocean(spark, d), ["cell", "y"], "m").groupBy("cell", "y").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT c_custkey k, [10, 11, 56, 1, 2, 3, 7][c_custkey % 7 + 1] code, -180e0 + (c_custkey * 37 % 3600) / 10e0 lon FROM customer)
    SELECT k, CAST(CASE WHEN code = 10 THEN CASE WHEN lon >= -70.5 AND lon < 20.5 THEN 1 WHEN lon >= 20.5 AND lon < 147.5 THEN 3 ELSE 2 END WHEN code = 11 THEN 1 WHEN code = 56 THEN 3 WHEN code BETWEEN 1 AND 3 THEN code END AS INT) basin FROM c""")
def basin_recode(spark, d):
    from .fixture import table

    code = F.element_at(F.array(*(F.lit(x) for x in (10, 11, 56, 1, 2, 3, 7))), (F.col("c_custkey") % 7 + 1).cast("int"))
    lon = F.lit(-180.0) + (F.col("c_custkey") * 37 % 3600) / F.lit(10.0)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), repair.basins_simplified(code, lon).cast("int").alias("basin"))


@query("""WITH lat AS (SELECT DISTINCT -80e0 + s_nationkey * 6 lat FROM supplier), lon AS (SELECT DISTINCT CAST(c_custkey % 36 AS DOUBLE) * 10 + 5 lon FROM customer),
    a AS (SELECT lat, coalesce((lag(lat) OVER w + lat)/2, -90) so, coalesce((lead(lat) OVER w + lat)/2, 90) no FROM lat WINDOW w AS (ORDER BY lat)),
    c AS (SELECT lon, coalesce((lon - lag(lon) OVER w + lead(lon) OVER w - lon)/2, lead(lon) OVER w - lon, lon - lag(lon) OVER w) wd FROM lon WINDOW w AS (ORDER BY lon))
    SELECT lat, lon, round(6371e3*radians(wd)*6371e3*(sin(radians(no))-sin(radians(so)))/1e6, 2)+0 area, round(6371e3*radians(wd)*cos(radians(so)), 2)+0 scalex FROM a, c""")
def cell_area_scale(spark, d):
    from .fixture import table

    lats = table(spark, d, "supplier").select((F.lit(-80.0) + F.col("s_nationkey") * 6).alias("lat")).distinct()
    lons = table(spark, d, "customer").select(((F.col("c_custkey") % 36).cast("double") * 10 + 5).alias("lon")).distinct()
    found = repair.cell_areas(lats, lons)
    return found.select("lat", "lon", (F.round(F.col("area") / 1e6, 2) + 0.0).alias("area"), (F.round("scalex", 2) + 0.0).alias("scalex"))


@query("""WITH s AS (SELECT s_suppkey c, -90e0 + (s_suppkey * 17 % 1800)/10e0 la, (s_suppkey * 53 % 3600)/10e0 lo, s_acctbal v FROM supplier),
    t AS (SELECT c_custkey c, -90e0 + (c_custkey * 7 % 1800)/10e0 la, (c_custkey * 29 % 3600)/10e0 lo FROM customer),
    u AS (SELECT c, v, cos(radians(la))*cos(radians(lo)) x, cos(radians(la))*sin(radians(lo)) y, sin(radians(la)) z FROM s), w AS (SELECT c, cos(radians(la))*cos(radians(lo)) x, cos(radians(la))*sin(radians(lo)) y, sin(radians(la)) z FROM t),
    p0 AS (SELECT w.c dst, u.c src, v, round(sqrt((u.x-w.x)**2+(u.y-w.y)**2+(u.z-w.z)**2), 12) ch FROM w, u), p AS (SELECT *, 2*asin(least(ch/2, 1)) dd FROM p0),
    k AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY dd, src) r FROM p)
    SELECT dst cell, round(sum(v/(dd+1e-9))/sum(1/(dd+1e-9)) + 1.3e-7, 4)+0 v FROM k WHERE r <= 4 GROUP BY dst""")
def regrid_inverse_distance(spark, d):
    from .fixture import table

    def cells(name, key, a, b):
        k = F.col(key)
        return table(spark, d, name).select(k.alias("cell"), (F.lit(-90.0) + (k * a % 1800) / F.lit(10.0)).alias("lat"), ((k * b % 3600) / F.lit(10.0)).alias("lon"))

    weights = sphere.inverse_distance_weights(cells("supplier", "s_suppkey", 17, 53), cells("customer", "c_custkey", 7, 29))
    field = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_acctbal").alias("v"))
    return _rounded(time_space.regrid(field, weights, "cell", [], ["v"]), ["cell"], ["v"])
