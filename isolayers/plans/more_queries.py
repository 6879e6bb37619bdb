"""Queries of the rarer operators: fluxes on density, regions and seasons, scenarios, masks, catalogs. Their SQL is written from the rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.density_grid import SURFACE
from ..functions.eos import density_flux_heat, density_flux_water
from ..operators import change, columns, emergence, ensemble, repair, surface, time_space
from ..sources import tables
from ..streaming.annual import append_annual_means
from .fixture import ANNUAL, BOTTOM, GRID, KEYS, OCEAN, PROFILE, ocean, on_density_sql, place_sql, r4, sub_sql, table
from .ocean_queries import _BOWL, annual
from .statistics_queries import BOX, ENS, FILES, SIG, R, _box_sql, _transformed_sql, boxes, catalog, ens, fields, members, signal

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def r3(x):
    return F.round((F.col(x) if isinstance(x, str) else x) + 1.3e-6, 3) + F.lit(0.0)


_DZ = "dz AS (SELECT cell, y, m, lev, coalesce(lead(z) OVER w - z, z - lag(z) OVER w) dz FROM o WINDOW w AS (PARTITION BY cell, y, m ORDER BY lev))"


@query(f"""WITH {OCEAN}, {sub_sql()}, {_DZ}, {BOTTOM}, x AS (SELECT cell, y, m, arg_max(z + coalesce(dz, 0)/2, (rho, lev)) z, arg_max(CASE WHEN dz IS NULL THEN 0 ELSE 1 END, (rho, lev)) k FROM sub JOIN dz USING (cell, y, m, lev) GROUP BY ALL)
    SELECT cell, y, m, bot.rho_idx, {R('x.z')} z FROM bot JOIN x USING (cell, y, m) WHERE k = 1""")
def bottom_half_level(spark, d):
    """The densest bin of each column, as deep as the lower edge of the densest level."""
    rows = columns.level_thickness(ocean(spark, d), KEYS, "lev", "z")
    found = columns.density_profile(rows, KEYS, "lev", "rho", "z", [], GRID, dz="dz")
    last = found.groupBy(*KEYS).agg(F.max(F.struct("rho_idx", "z")).alias("b"))
    single = rows.groupBy(*KEYS).agg(F.count("dz").alias("n")).where("n > 0")  # a column of one level has no thickness
    return last.join(single, KEYS, "left_semi").select(*KEYS, "b.rho_idx", r4("b.z").alias("z"))


_FLUX = PROFILE.replace(sub_sql(), f"""a0 AS (SELECT *, (t - 20)*z*1e-2 a FROM o), o2 AS (SELECT cell, y, m, lev, z, sum(a) OVER (PARTITION BY cell, y, m ORDER BY lev ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) t,
    sum(a) OVER (PARTITION BY cell, y, m) s, rho FROM a0), {sub_sql('o2')}""") + """, fl AS (SELECT *, coalesce(lag(t) OVER w, s) - CASE WHEN lead(rho_idx) OVER w IS NULL THEN 0 ELSE t END f FROM prof WINDOW w AS (PARTITION BY cell, y, m ORDER BY rho_idx))"""


def _fluxes(spark, d):
    return columns.flux_on_density(ocean(spark, d), KEYS, "lev", "rho", "z", (F.col("t") - 20) * F.col("z") * 1e-2, GRID)


@query(f"WITH {OCEAN}, {sub_sql()}, k AS (SELECT DISTINCT cell, y, m FROM sub) SELECT cell, y, m, round(sum((t - 20)*z*1e-2) + 1.3e-6, 3)+0 total FROM o SEMI JOIN k USING (cell, y, m) GROUP BY ALL")
def flux_conserved(spark, d):
    """The bins' fluxes add up to what the levels have."""
    return _fluxes(spark, d).groupBy(*KEYS).agg(r3(F.sum("flux")).alias("total"))


@query(f"WITH {_FLUX} SELECT cell, y, m, rho_idx, round(sum(f) OVER (PARTITION BY cell, y, m ORDER BY rho_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1.3e-6, 3)+0 below FROM fl")
def stream_function(spark, d):
    return columns.from_bottom(_fluxes(spark, d), KEYS, "rho_idx", F.col("flux"), "below").select(*KEYS, "rho_idx", r3("below").alias("below"))


@query(f"WITH {_FLUX} SELECT y, m, rho_idx, CAST(cell % 25 AS INT) lat, round(sum(f*(1 + cell // 25)) + 1.3e-6, 3)+0 transport FROM fl GROUP BY ALL")
def zonal_transport(spark, d):
    rows = _fluxes(spark, d).withColumn("width", 1 + F.floor(F.col("cell") / 25)).withColumn("lat", (F.col("cell") % 25).cast("int"))
    found = time_space.zonal_transport(rows, ["y", "m", "rho_idx", "lat"], "flux", "width", 1.0)
    return found.select("y", "m", "rho_idx", "lat", r3("transport").alias("transport"))


@query(f"""WITH {OCEAN}, p AS (SELECT {place_sql('round(rho, 1)')} p FROM o), i AS (SELECT unnest(CASE WHEN p = floor(p) THEN [p - 1, p] ELSE [floor(p)] END) i FROM p)
    SELECT CAST(i AS INT) rho_idx, count(*) n FROM i WHERE i BETWEEN 0 AND 59 GROUP BY ALL""")
def bins_closed(spark, d):
    rows = ocean(spark, d).select(F.explode(GRID.bins_closed(F.round("rho", 1))).alias("rho_idx"))
    return rows.groupBy("rho_idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OCEAN}, x AS (SELECT *, CASE WHEN rho < 22 THEN 0 WHEN rho < 24 THEN 1 WHEN rho < 26 THEN 2 WHEN rho < 27 THEN 3 ELSE 4 END layer FROM o)
    SELECT cell, y, CAST(layer AS INT) layer, {R('sum(s*z)/sum(z) - 34.6')} s, round(sum(z) + 1.3e-6, 3)+0 z FROM x GROUP BY ALL""")
def content_layers(spark, d):
    found = columns.content_layers(ocean(spark, d), ["cell", "y"], "rho", "s", "z", [22, 24, 26, 27], -34.6)
    return found.select("cell", "y", "layer", r4("s").alias("s"), r3("z").alias("z"))


@query(f"""WITH {PROFILE}, {ANNUAL}, b AS (SELECT cell, y, max(z) + 100 bottom FROM ann GROUP BY ALL), x AS (SELECT *, lead(z) OVER (PARTITION BY cell, y ORDER BY rho_idx) low FROM ann JOIN b USING (cell, y))
    SELECT cell, y, rho_idx, {R('CASE WHEN low IS NULL THEN bottom ELSE low END - z')} height, round((CASE WHEN low IS NULL THEN bottom ELSE low END - z)*(1 + cell % 7) + 1.3e-6, 3)+0 volume FROM x""")
def layer_heights(spark, d):
    column = Window.partitionBy("cell", "y").orderBy("rho_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = annual(spark, d).withColumn("bottom", F.max("z").over(column) + 100).withColumn("area", 1 + F.col("cell") % 7)
    return columns.layer_heights(rows, ["cell", "y"], "z", "bottom", "area").select("cell", "y", "rho_idx", r4("height").alias("height"), r3("volume").alias("volume"))


@query(f"WITH {OCEAN} SELECT lev, CAST(cell % 25 AS INT) lat, y, {R('sum(t*(1 + cell // 25))/sum(1 + cell // 25)')} t FROM o GROUP BY ALL")
def zonal_mean_weighted(spark, d):
    rows = ocean(spark, d).withColumn("lat", (F.col("cell") % 25).cast("int"))
    return time_space.zonal_mean(rows, ["lev", "lat", "y"], ["t"], 1 + F.floor(F.col("cell") / 25)).select("lev", "lat", "y", r4("t").alias("t"))


@query(f"WITH {OCEAN} SELECT cell, y, count(*) n FROM o WHERE m IN (3, 4, 5, 6) GROUP BY ALL")
def month_slice(spark, d):
    return tables.time_slice(ocean(spark, d), "m", "3,4").groupBy("cell", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OCEAN} SELECT cell, y, m, lev, {R('CASE WHEN lev <> 2 THEN s*0.9953e0 END')} s FROM o")
def absolute_salinity_recoded(spark, d):
    rows = ocean(spark, d).withColumn("s", F.when(F.col("lev") == 2, -999.0).otherwise(F.col("s")))
    return rows.select(*KEYS, "lev", r4(repair.practical_salinity(repair.recoded(F.col("s"), -999.0))).alias("s"))


@query(f"WITH {OCEAN} SELECT cell, y, m, CAST(count(*) OVER (PARTITION BY cell, y, m ORDER BY z) AS INT) lev, z FROM o")
def levels_by_depth(spark, d):
    """Levels that were stored bottom-up."""
    rows = ocean(spark, d).withColumn("lev", 8 - F.col("lev"))
    return repair.levels_by_depth(rows, KEYS, "lev", "z").select(*KEYS, "lev", "z")


@query(f"WITH {OCEAN} SELECT cell, count(*) n, count(DISTINCT y) n_y, count(DISTINCT m) n_m, count(DISTINCT lev) n_lev FROM o GROUP BY cell")
def shapes(spark, d):
    return repair.shapes(ocean(spark, d), ["cell"], ["y", "m", "lev"])


@query(f"WITH {ENS} SELECT lat, y, {R('sum(CASE WHEN r % 2 = 0 THEN v END)/count(*)')} v FROM e GROUP BY ALL HAVING count(CASE WHEN r % 2 = 0 THEN v END) > 0")
def ens_zero_filled(spark, d):
    rows = ens(spark, d).withColumn("half", F.when(F.col("r") % 2 == 0, F.col("v")))
    known = rows.where("half IS NOT NULL").select("lat", "y").distinct()
    found = ensemble.zero_filled(rows.drop("v").withColumnRenamed("half", "v"), ["v"]).groupBy("lat", "y").agg(r4(F.avg("v")).alias("v"))
    return found.join(known, ["lat", "y"], "left_semi")


@query(f"WITH {ENS}, t AS (SELECT max(y) t FROM e) SELECT lat, r, y, count(*) n FROM e, t WHERE y > t.t - 2 GROUP BY ALL")
def ens_last_years_of_all(spark, d):
    return ensemble.time_window(ens(spark, d), "y", last=2).groupBy("lat", "r", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SIG}, q AS (SELECT k, CAST(coalesce(max(CASE WHEN NOT coalesce(abs(x) >= (0.05*n1)*(1 - 1e-9), false) THEN i END) + 1, count(*)) AS INT) toe, count(*) n FROM sg GROUP BY k)
    SELECT k, CASE WHEN toe <> (SELECT max(n) FROM q) THEN toe END toe FROM q""")
def toe_emerged_only(spark, d):
    rows = signal(spark, d)
    found = emergence.time_of_emergence(rows, ["k"], "i", F.col("x"), F.col("n1"), 0.05)
    steps = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("steps"))
    return emergence.emerged_only(found.crossJoin(F.broadcast(steps)), "toe", F.col("steps")).drop("steps")  # one row


# Scenarios of the ensemble: history to 1998, the future after it, even members as natural runs, the years to 1996 as the control.
_SCENARIO = f"""{ENS}, nat AS (SELECT lat, r, y, avg(v) c FROM e WHERE y <= 1998 AND member % 2 = 0 GROUP BY ALL), ctl AS (SELECT lat, r, avg(v) c FROM e WHERE y <= 1996 GROUP BY ALL),
    two AS (SELECT member, model FROM e GROUP BY ALL HAVING min(y) <= 1998 AND max(y) > 1998),
    sc AS (SELECT member, model, lat, r, y, v - c x FROM e JOIN nat USING (lat, r, y) SEMI JOIN two USING (member, model) WHERE y <= 1998 UNION ALL
      SELECT member, model, lat, r, y, v - c FROM e JOIN ctl USING (lat, r) SEMI JOIN two USING (member, model) WHERE y > 1998)"""


def _scenario(spark, d):
    return emergence.scenario_block(ens(spark, d), ["member", "model"], ["lat", "r"], "y", "v", 1999, F.col("member") % 2 == 0, F.col("y") <= 1996, "x")


@query(f"WITH {_SCENARIO} SELECT member, model, lat, r, y, {R('x')} x FROM sc")
def scenario_signal(spark, d):
    return _scenario(spark, d).select("member", "model", "lat", "r", "y", r4("x").alias("x"))


@query(f"""WITH {_SCENARIO}, n AS (SELECT lat, r, max(s1) n1, max(s2) n2 FROM (SELECT lat, r, member, stddev_pop(v) FILTER (y <= 1998) s1, stddev_pop(v) FILTER (y > 1998) s2 FROM e GROUP BY ALL) GROUP BY ALL)
    SELECT member, model, lat, r, CAST(coalesce(max(CASE WHEN NOT coalesce(abs(x) >= (0.5*CASE WHEN y < 1999 THEN n1 ELSE n2 END)*(1 - 1e-9), false) THEN y END) - min(y) + 1, count(*)) AS INT) toe FROM sc JOIN n USING (lat, r) GROUP BY ALL""")
def toe_scenarios(spark, d):
    """Time of emergence per point over history and future, each with its own noise."""
    return emergence.time_of_emergence_2(_scenario(spark, d), ["member", "model", "lat", "r"], "y", F.col("x"), F.col("noise1"), F.col("noise2"), 1999, 0.5)


@query(f"""WITH {_SCENARIO}, {BOX}, ba AS (SELECT * FROM {_box_sql('sc', 'model, member, y', 'x')}), nz AS (SELECT model, max(s) s FROM (SELECT model, member, stddev_pop(v) s FROM ba WHERE y <= 1998 GROUP BY ALL) GROUP BY ALL)
    SELECT model, member, CAST(coalesce(max(CASE WHEN NOT coalesce(abs(v) >= (0.5*s)*(1 - 1e-9), false) THEN y END) - min(y) + 1, count(*)) AS INT) toe FROM ba JOIN nz USING (model) GROUP BY ALL""")
def toe_box_scenarios(spark, d):
    means = emergence.box_average(_scenario(spark, d), boxes(spark), ["model"], ["model", "member", "y"], "lat", "r", "x")
    means = emergence.signal_and_noise(means, ["model"], ["member"], "x", noisy=F.col("y") <= 1998)
    return emergence.time_of_emergence(means, ["model", "member"], "y", F.col("x"), F.col("noise"), 0.5)


@query(f"""WITH {ENS}, {BOX}, ba AS (SELECT * FROM {_box_sql('e', 'model, member, y')}), tp AS (SELECT model, member, max(y) t FROM ba GROUP BY ALL), ct AS (SELECT model, member, v FROM ba JOIN tp USING (model, member) WHERE y > t - 3),
    k AS (SELECT model, avg(v) c FROM ct GROUP BY ALL), nz AS (SELECT model, max(s) s FROM (SELECT model, member, stddev_pop(v) s FROM ct GROUP BY ALL) GROUP BY ALL)
    SELECT model, member, CAST(coalesce(max(CASE WHEN NOT coalesce(abs(v - c) >= (0.5*s)*(1 - 1e-9), false) THEN y END) - min(y) + 1, count(*)) AS INT) toe FROM ba JOIN k USING (model) JOIN nz USING (model) WHERE y <= 1999 GROUP BY ALL""")
def toe_box_control(spark, d):
    """A run against the last years of a control: mean and largest spread of these."""
    means = emergence.box_average(ens(spark, d), boxes(spark), ["model"], ["model", "member", "y"], "lat", "r", "v")
    last = F.max("y").over(Window.partitionBy("model", "member"))
    rows = emergence.signal_and_noise(means.withColumn("last", last), ["model"], ["member"], "v", F.col("y") > F.col("last") - 3).where("y <= 1999")
    return emergence.time_of_emergence(rows, ["model", "member"], "y", F.col("signal"), F.col("noise"), 0.5)


_TOE_POINTS = f"""{ENS}, c AS (SELECT lat, r, avg(v) c FROM e GROUP BY ALL), pt AS (SELECT member, model, lat, r, CAST(coalesce(max(CASE WHEN NOT coalesce(abs(v - c) >= (3)*(1 - 1e-9), false) THEN y END) - min(y) + 1, count(*)) AS INT) toe
    FROM e JOIN c USING (lat, r) GROUP BY ALL)"""


def _toe_points(spark, d):
    rows = emergence.signal_and_noise(ens(spark, d), ["lat", "r"], ["member"], "v", out="x")
    return emergence.time_of_emergence(rows, ["member", "model", "lat", "r"], "y", F.col("x"), F.lit(3.0))


@query(f"WITH {_TOE_POINTS}, {BOX} SELECT model, member, CAST(round_even(v, 0) AS INT) toe FROM {_box_sql('pt', 'model, member', 'toe')}")
def average_toe(spark, d):
    return emergence.average_of_emergence(_toe_points(spark, d), boxes(spark), ["model"], ["model", "member"], "lat", "r")


@query(f"""WITH {_TOE_POINTS}, t AS (SELECT model, lat, median(toe) toe FROM pt GROUP BY ALL), n AS (SELECT model, lat, max(s) noise FROM (SELECT model, lat, r, member, stddev_pop(v) s FROM e GROUP BY ALL) GROUP BY ALL)
    SELECT model, lat, toe, {R('noise')} noise FROM t JOIN n USING (model, lat)""")
def toe_noise_pairs(spark, d):
    noise = ens(spark, d).groupBy("model", "lat", "r", "member").agg(F.stddev_pop("v").alias("noise"))
    return emergence.paired_with_noise(_toe_points(spark, d), noise, ["model"], "lat").select("model", "lat", "toe", r4("noise").alias("noise"))


@query(f"""WITH {ENS}, {BOX}, ba AS (SELECT * FROM {_box_sql('e', 'model, member, y')}), f AS (SELECT * FROM e WHERE y <= 1996), bc AS (SELECT model, member, avg(v) c FROM {_box_sql('f', 'model, member, y')} GROUP BY ALL)
    SELECT model, member, y, {R('v - c')} v FROM ba JOIN bc USING (model, member)""")
def box_series(spark, d):
    rows = ens(spark, d)
    found = emergence.box_series(rows, rows.where("y <= 1996"), boxes(spark), ["model"], ["model", "member"], "y", "lat", "r", "v")
    return found.select("model", "member", "y", r4("v").alias("v"))


def _fluxes_at_surface(spark, d):
    t, s = F.col("t"), F.col("s")
    return fields(spark, d).withColumn("heat", density_flux_heat(F.col("q"), t, s)).withColumn("water", density_flux_water(F.col("w"), t, s))


_WIDE = "(CASE WHEN b < 30 THEN 0.1e0 ELSE 0.05e0 END)"


@query(f"""WITH {_transformed_sql()}, x AS (SELECT *, 'Global' basin FROM d1 UNION ALL SELECT *, 'b' || (k % 3) FROM d1)
    SELECT basin, m, b rho_idx, {R(f'sum(h*a)/{_WIDE}*1e6')} heat, sum(a) area FROM x WHERE b BETWEEN 0 AND 109 GROUP BY basin, m, b""")
def transformation_by_basin(spark, d):
    rows = _fluxes_at_surface(spark, d).withColumn("basin", F.concat(F.lit("b"), F.col("k") % 3))
    found = surface.outcrop_transformation(time_space.with_global(rows), ["basin", "m"], "rho", ["heat"], "a", SURFACE, 1e6)
    return found.select("basin", "m", "rho_idx", r4("heat").alias("heat"), "area")


@query(f"""WITH {_transformed_sql()}, rg(region, y1, y2, x1, x2) AS (VALUES ('north', 0, 20, -180, 180), ('west', -20, 20, -180, 0), ('line', -20, 5, 100, -100)), x AS (SELECT d1.*, (k*37) % 360 - 180 lon FROM d1)
    SELECT region, b rho_idx, {R(f'sum(f*a)/{_WIDE}*1e6')} water FROM x, rg WHERE b BETWEEN 0 AND 109 AND lat >= y1 AND lat < y2 AND CASE WHEN x1 <= x2 THEN lon >= x1 AND lon < x2 ELSE lon >= x1 OR lon < x2 END GROUP BY region, b""")
def transformation_by_region(spark, d):
    regions = spark.createDataFrame([("north", 0, 20, -180, 180), ("west", -20, 20, -180, 0), ("line", -20, 5, 100, -100)], "region string, latmin int, latmax int, lonmin int, lonmax int")
    rows = _fluxes_at_surface(spark, d).withColumn("lon", F.col("k") * 37 % 360 - 180)
    found = surface.outcrop_transformation(surface.in_regions(rows, regions, "lat", "lon"), ["region"], "rho", ["water"], "a", SURFACE, 1e6)
    return found.select("region", "rho_idx", r4("water").alias("water"))


@query(f"""WITH {_transformed_sql()}, x AS (SELECT k % 2 run, CASE WHEN m IN (12, 1, 2) THEN 'DJF' WHEN m <= 5 THEN 'MAM' WHEN m <= 8 THEN 'JJA' ELSE 'SON' END season, b rho_idx, sum(h*a)/{_WIDE}*1e6 heat FROM d1 WHERE b BETWEEN 0 AND 109 GROUP BY 1, 2, 3, b)
    SELECT season, rho_idx, {R('coalesce(sum(heat) FILTER (run = 0), 0) - coalesce(sum(heat) FILTER (run = 1), 0)')} heat FROM x GROUP BY ALL""")
def seasonal_difference(spark, d):
    rows = _fluxes_at_surface(spark, d).withColumn("season", surface.season(F.col("m")))
    run = lambda k: surface.outcrop_transformation(rows.where(F.col("k") % 2 == k), ["season"], "rho", ["heat"], "a", SURFACE, 1e6)
    return surface.run_difference(run(0), run(1), ["season", "rho_idx"], ["heat"]).select("season", "rho_idx", r4("heat").alias("heat"))


@query(f"WITH {FILES}, k AS (SELECT 'model' || (c_custkey % 50) model, max(c_custkey % 200) yrs FROM customer GROUP BY 1) SELECT file FROM ca SEMI JOIN (SELECT model FROM k WHERE yrs >= 140) q USING (model)")
def selected_runs(spark, d):
    k = F.col("c_custkey")
    models = table(spark, d, "customer").groupBy(F.concat(F.lit("model"), k % 50).alias("model")).agg(F.max(k % 200).alias("control_years"))
    return tables.selected_runs(catalog(spark, d), models, "historical").select("file")


@query(f"WITH {FILES} SELECT model, member, variable, string_agg(DISTINCT version, ',' ORDER BY version) versions FROM ca GROUP BY ALL HAVING count(DISTINCT version) > 1")
def version_clashes(spark, d):
    found = tables.version_clashes(catalog(spark, d), ["model", "member", "variable"])
    return found.withColumn("versions", F.array_join("versions", ","))


@query(f"""WITH {FILES} SELECT file, CAST(row_number() OVER (PARTITION BY model, variable, version ORDER BY CASE WHEN member = 'r1i1p1' THEN 0 ELSE 1 END, member) AS INT) priority FROM ca""")
def member_priority(spark, d):
    return tables.first_member_first(catalog(spark, d), ["model", "variable", "version"]).select("file", "priority")


@query(f"WITH {OCEAN}, s AS (SELECT cell, y, lev, avg(s) rhopoto FROM o WHERE m <= 6 GROUP BY ALL), g AS (SELECT cell, y, lev, avg(t) t FROM o GROUP BY ALL) SELECT cell, y, lev, {R('t')} t, {R('rhopoto')} rhopoto FROM g LEFT JOIN s USING (cell, y, lev)")
def merged_variable(spark, d):
    rows = ocean(spark, d)
    side = rows.where("m <= 6").groupBy("cell", "y", "lev").agg(F.avg("s").alias("rhopoto"))
    found = tables.merged_variable(rows.groupBy("cell", "y", "lev").agg(F.avg("t").alias("t")), side, ["cell", "y", "lev"], "rhopoto")
    return found.select("cell", "y", "lev", r4("t").alias("t"), r4("rhopoto").alias("rhopoto"))


@query(f"WITH {OCEAN} SELECT cell, y, m, lev, [0e0, 10, 40, 130, 350, 850, 1850][lev] z, {R('t')} t FROM o")
def other_axes(spark, d):
    depths = [0.0, 10.0, 40.0, 130.0, 350.0, 850.0, 1850.0]
    axes = spark.createDataFrame([(i + 1, z) for i, z in enumerate(depths)], "lev int, z double")
    return time_space.with_axes(ocean(spark, d), F.broadcast(axes), ["lev"]).select(*KEYS, "lev", "z", r4("t").alias("t"))  # an axis has few levels


@query(f"""WITH {OCEAN}, x AS (SELECT cell, lev, avg(t) m, avg(t) FILTER (y >= 1999) - avg(t) FILTER (y <= 1996) c FROM o GROUP BY ALL) SELECT cell, lev, {R('m - c/2')} "begin", {R('m + c/2')} "end" FROM x""")
def mid_period(spark, d):
    mean = lambda c: F.avg(F.when(c, F.col("t")))
    rows = ocean(spark, d).groupBy("cell", "lev").agg(F.avg("t").alias("m"), (mean(F.col("y") >= 1999) - mean(F.col("y") <= 1996)).alias("c"))
    return change.mid_period(rows, "m", "c").select("cell", "lev", r4("begin").alias("begin"), r4("end").alias("end"))


@query(f"""WITH {OCEAN}, f AS (SELECT CAST(cell // 25 AS INT) lon, CAST(cell % 25 AS INT) lat, lev*0.25e0 r, avg(s) FILTER (y <= 1997) x1, avg(s) FILTER (y >= 1999) x2 FROM o GROUP BY ALL),
    h AS (SELECT lon, r, lat, x2, lead(lat) OVER w lat2, lead(x2) OVER w x3 FROM f WINDOW w AS (PARTITION BY lon, r ORDER BY lat)), g AS (SELECT lon, r, lat, unnest(CASE WHEN lat2 IS NULL THEN [0] ELSE range(4) END) k, x2, lat2, x3 FROM h),
    q AS (SELECT lon, r, CASE WHEN k = 0 THEN lat ELSE lat + k/4e0*(lat2 - lat) END la, CASE WHEN k = 0 THEN x2 ELSE x2 + k/4e0*(x3 - x2) END x FROM g)
    SELECT lon, r, count(*) n, round(sum(la) + 1.3e-6, 3)+0 lats, {R('sum(x)')} xs FROM q GROUP BY ALL""")
def refined_latitudes(spark, d):
    lon, lat = F.floor(F.col("cell") / 25).cast("int").alias("lon"), (F.col("cell") % 25).cast("int").alias("lat")
    rows = ocean(spark, d).groupBy(lon, lat, (F.col("lev") * 0.25).alias("r")).agg(F.avg(F.when(F.col("y") <= 1997, F.col("s"))).alias("x1"), F.avg(F.when(F.col("y") >= 1999, F.col("s"))).alias("x2"))
    found = change.refined(rows, ["lon", "r"], "lat", "x2", 4)
    return found.groupBy("lon", "r").agg(F.count(F.lit(1)).alias("n"), r3(F.sum("lat")).alias("lats"), r4(F.sum("x2")).alias("xs"))


@query(f"""WITH {OCEAN}, g AS (SELECT cell, y, lev, z, avg(t) t FROM o GROUP BY ALL), n AS (SELECT *, count(t) OVER (PARTITION BY cell, y) n FROM g), l AS (SELECT cell, y, CASE WHEN y % 2 = 0 THEN 20e0 END top, 400e0 + 200*(cell % 7) bottom FROM g GROUP BY ALL)
    SELECT cell, y, lev, {R('CASE WHEN coalesce(z < top, false) OR z > bottom THEN NULL ELSE t END')} t FROM n JOIN l USING (cell, y) WHERE n >= 4""")
def masked_columns(spark, d):
    rows = ocean(spark, d).groupBy("cell", "y", "lev", "z").agg(F.avg("t").alias("t"))
    limits = rows.select("cell", "y").distinct().select("cell", "y", F.when(F.col("y") % 2 == 0, 20.0).alias("top"), (400.0 + 200 * (F.col("cell") % 7)).alias("bottom"))
    found = change.masked_column(change.columns_with(rows, ["cell", "y"], "t"), limits, ["cell", "y"], "z", "t", "top", "bottom")
    return found.select("cell", "y", "lev", r4("t").alias("t"))


@query(f"""WITH {OCEAN}, g AS (SELECT cell, y, z, avg(t) t, 1e0 + min(lev) v FROM o GROUP BY ALL), tg AS (SELECT DISTINCT cell, y, unnest([50e0, 300, 1000]) d FROM g),
    q AS (SELECT tg.cell, tg.y, d, max(CASE WHEN z <= d THEN z END) a, min(CASE WHEN z >= d THEN z END) b, arg_max(t*v, CASE WHEN z <= d THEN z END) ta, arg_min(t*v, CASE WHEN z >= d THEN z END) tb,
      arg_max(v, CASE WHEN z <= d THEN z END) va, arg_min(v, CASE WHEN z >= d THEN z END) vb FROM tg JOIN g USING (cell, y) GROUP BY ALL)
    SELECT cell, y, d, {R('CASE WHEN a < b THEN (ta + (d-a)/(b-a)*(tb-ta))/(va + (d-a)/(b-a)*(vb-va)) END')} t FROM q""")
def remap_by_interpolation(spark, d):
    rows = ocean(spark, d).groupBy("cell", "y", "z").agg(F.avg("t").alias("t"), (1.0 + F.min("lev")).alias("v"))
    targets = rows.select("cell", "y").distinct().withColumn("d", F.explode(F.array(F.lit(50.0), F.lit(300.0), F.lit(1000.0))))
    return change.remap_by_interpolation(rows, ["cell", "y"], "z", "v", "t", targets, "d").select("cell", "y", "d", r4("t").alias("t"))


@query(f"WITH {PROFILE}, {ANNUAL}, b AS (SELECT cell, y, 1e0*min(rho_idx) s FROM ann GROUP BY ALL) SELECT cell, {R('avg(s) FILTER (y BETWEEN 1999 AND 2000) - avg(s) FILTER (y BETWEEN 1995 AND 1996)')} shift FROM b WHERE y BETWEEN 1995 AND 1996 OR y BETWEEN 1999 AND 2000 GROUP BY ALL")
def bowl_shift(spark, d):
    bowl = change.bowl_from_data(annual(spark, d), ["cell", "y"], "rho_idx", "t").withColumn("bowl", F.col("bowl").cast("double"))
    return change.period_difference(bowl, ["cell"], "y", "bowl", (1995, 1996), (1999, 2000)).select("cell", r4("change").alias("shift"))


@query("""WITH c AS (SELECT c_custkey cell, -90e0 + (c_custkey * 7 % 1800)/10e0 lat, (c_custkey * 29 % 3600)/10e0 lon, CAST(c_nationkey % 3 + 1 AS INT) basin FROM customer),
    p(plat, plon, before, after) AS (VALUES (10e0, 20e0, 3, 2), (-45e0, 300e0, 3, 2), (60e0, 5e0, 2, 1), (0e0, 90e0, NULL, 7), (-70e0, 10e0, NULL, 8)),
    n AS (SELECT before, after, arg_min(cell, (round(sin(radians(lat-plat)/2)**2 + cos(radians(lat))*cos(radians(plat))*sin(radians(lon-plon)/2)**2, 15), cell)) cell FROM c, p GROUP BY before, after, plat, plon)
    SELECT cell, coalesce((SELECT min(after) FROM n WHERE n.cell = c.cell AND coalesce(before = basin, true)), basin) basin FROM c""")
def points_corrected(spark, d):
    k = F.col("c_custkey")
    cells = table(spark, d, "customer").select(
        k.alias("cell"), (F.lit(-90.0) + (k * 7 % 1800) / F.lit(10.0)).alias("lat"), ((k * 29 % 3600) / F.lit(10.0)).alias("lon"), (F.col("c_nationkey") % 3 + 1).cast("int").alias("basin")
    )
    points = spark.createDataFrame([(10.0, 20.0, 3, 2), (-45.0, 300.0, 3, 2), (60.0, 5.0, 2, 1), (0.0, 90.0, None, 7), (-70.0, 10.0, None, 8)], "lat double, lon double, before int, after int")
    return repair.points_corrected(cells, points).select("cell", "basin")


@query("""WITH a AS (SELECT c_custkey cell, 1e0 + c_custkey % 13 area FROM customer), t AS (SELECT sum(area) s FROM a) SELECT cell, round(area/s*510.072e6, 2)+0 area FROM a, t""")
def normalised_areas(spark, d):
    cells = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), (1.0 + F.col("c_custkey") % 13).alias("area"))
    return repair.normalised_areas(cells, "area").select("cell", (F.round(F.col("area") / 1e6, 2) + 0.0).alias("area"))


@query(f"WITH {OCEAN}, {on_density_sql('o')} SELECT rho_idx, round(avg(s) + 1.3e-7, 4)+0 s, count(*) n FROM ins GROUP BY ALL")
def isopycnal_means(spark, d):
    rows = columns.on_density(ocean(spark, d), KEYS, "lev", "rho", ["s"], GRID)
    return rows.groupBy("rho_idx").agg(r4(F.avg("s")).alias("s"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OCEAN}, k AS (SELECT DISTINCT cell, y, m FROM o), g AS (SELECT cell, y, m, CAST(i AS INT) i FROM k, (SELECT unnest(range(1, 9)) i))
    SELECT cell, y, m, min(i) - 1 bottom FROM g ANTI JOIN o ON g.cell = o.cell AND g.y = o.y AND g.m = o.m AND g.i = o.lev GROUP BY ALL HAVING min(i) > 1""")
def bottom_level(spark, d):
    return columns.bottom_level(ocean(spark, d), KEYS, "lev", "s")


@query(f"WITH {PROFILE}, {ANNUAL} SELECT cell, y, {R('t')} t, {R('z')} z FROM ann WHERE rho_idx = 30")
def one_density_level(spark, d):
    return tables.time_slice(annual(spark, d, ("t",)), "rho_idx", "30,1").select("cell", "y", r4("t").alias("t"), r4("z").alias("z"))


def _few(sql: str) -> str:
    return sql.replace("CAST(l_suppkey AS BIGINT)", "CAST(l_suppkey % 5 AS BIGINT)")


def _annual_of_few(spark, d):
    """Five cells, whose columns have all twelve months."""
    rows = columns.density_profile(ocean(spark, d, 5, True), KEYS, "lev", "rho", "z", ["t", "s"], GRID)
    return time_space.annual_bins(rows, ["cell", "y", "rho_idx"], "z", ["t", "s"], "thick")


@query(f"""WITH {_few(_BOWL).replace('pers >= 50', 'pers >= 99')} SELECT bi.cell, bi.y, bowl_idx, {R('z')} ptop_z, {R('t')} ptop_t
    FROM bi LEFT JOIN ann ON ann.cell = bi.cell AND ann.y = bi.y AND rho_idx = bowl_idx""")
def bowl_of_all_months(spark, d):
    found = time_space.bowl(_annual_of_few(spark, d), ["cell", "y"], "pers", "z", ["z", "t"])
    return found.select("cell", "y", "bowl_idx", r4("ptop_z").alias("ptop_z"), r4("ptop_t").alias("ptop_t"))


@query(f"""WITH {_few(PROFILE)}, {ANNUAL}, c AS (SELECT y, cell % 2 half, cell, 1 + cell area, sum(CASE WHEN pers >= 98 THEN thick ELSE 0 END) h, sum(CASE WHEN pers >= 98 THEN t*thick END) th FROM ann GROUP BY ALL)
    SELECT y, half, round(sum(h*area), 3)+0 volume, {R('sum(th/(h + 1e-4)*area)/sum(area)')} t FROM c GROUP BY ALL""")
def persistent_volume_of_all_months(spark, d):
    rows = _annual_of_few(spark, d).withColumn("area", 1 + F.col("cell")).withColumn("half", F.col("cell") % 2)
    found = time_space.persistent_totals(rows, ["cell"], ["y", "half"], "pers", "thick", "area", ["t"])
    return found.select("y", "half", (F.round("volume", 3) + 0.0).alias("volume"), r4("t").alias("t"))


@query(f"""WITH {OCEAN}, a AS (SELECT cell, lev, y, avg(t) t FROM o GROUP BY ALL), c AS (SELECT cell, lev, avg(t) FILTER (y > 1998) - avg(t) FILTER (y <= 1998) c, stddev_pop(t) FILTER (y <= 1998) e FROM a GROUP BY ALL)
    SELECT cell, lev, CASE WHEN abs(c) >= 2*e THEN 1 ELSE 0 END significant FROM c WHERE c IS NOT NULL AND e > 0""")
def significance_over_control(spark, d):
    """Changes of at least twice the control's spread."""
    years = ocean(spark, d).groupBy("cell", "lev", "y").agg(F.avg("t").alias("t"))
    control, later = F.when(F.col("y") <= 1998, F.col("t")), F.when(F.col("y") > 1998, F.col("t"))
    rows = years.groupBy("cell", "lev").agg((F.avg(later) - F.avg(control)).alias("c"), F.stddev_pop(control).alias("e")).where("c IS NOT NULL AND e > 0")
    return rows.select("cell", "lev", change.significant(F.col("c"), F.col("e"), 1.0, 2.0).alias("significant"))


@query(f"""WITH {ENS}, u AS (SELECT member, lat, y, avg(v) v FROM e GROUP BY ALL), a AS (SELECT *, v - avg(v) FILTER (y < 1998) OVER (PARTITION BY member, lat) x FROM u)
    SELECT lat, y, {R('avg(v)')} v, {R('avg(CASE WHEN x < 0 THEN -1e0 WHEN x >= 0 THEN 1e0 END)')} agree, {R('stddev_pop(v)')} spread FROM a, nm GROUP BY ALL HAVING 100e0*count(v)/max(n) >= 50""")
def ens_lines(spark, d):
    """Mean, agreement and spread of members of a field without a vertical axis."""
    keys = ["lat", "y"]
    rows = ens(spark, d).groupBy("member", *keys).agg(F.avg("v").alias("v")).crossJoin(F.broadcast(members(spark, d)))  # one row
    found = ensemble.ensemble_block(rows, ["lat"], "member", "y", "v", F.col("n"), (0, 1998))
    return found.select(*keys, r4("mean").alias("v"), r4("agree").alias("agree"), r4("spread").alias("spread"))


_VOLUMES = """v3 AS (SELECT CAST(l_suppkey // 25 AS INT) member, CAST(l_suppkey % 25 AS INT) lat, CAST(l_linenumber AS INT) lon, CAST(p_size // 10 AS INT) r, CAST(year(l_shipdate) AS INT) y, avg(l_quantity) v
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), nm AS (SELECT count(DISTINCT l_suppkey // 25) n FROM lineitem)"""


@query(f"WITH {_VOLUMES}, s AS (SELECT lat, lon, r, max(s) std FROM (SELECT lat, lon, r, member, stddev_pop(v) s FROM v3 GROUP BY ALL) GROUP BY ALL), q AS (SELECT lat, lon, r, y, avg(v) v FROM v3, nm GROUP BY ALL HAVING 100e0*count(v)/max(n) >= 50) SELECT lat, lon, r, y, {R('v')} v, {R('std')} std FROM q JOIN s USING (lat, lon, r)")
def ens_volumes(spark, d):
    """Mean over members and largest spread in time of a field with latitude, longitude and density."""
    point = ["lat", "lon", "r"]
    items = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.floor(F.col("p_size") / 10).cast("int").alias("r")), "l_partkey")
    rows = items.groupBy(
        F.floor(F.col("l_suppkey") / 25).cast("int").alias("member"), (F.col("l_suppkey") % 25).cast("int").alias("lat"), F.col("l_linenumber").cast("int").alias("lon"), "r", F.year("l_shipdate").alias("y")
    ).agg(F.avg("l_quantity").alias("v"))
    rows = rows.crossJoin(F.broadcast(members(spark, d)))  # one row
    found = ensemble.ensemble_block(rows, point, "member", "y", "v", F.col("n"), (0, 1998))
    return found.select(*point, "y", r4("mean").alias("v"), r4("std").alias("std"))


_SEVEN = [f"v{i}" for i in range(7)]


def _sets(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.concat(F.lit("v"), F.col("o_orderkey") % 7).alias("variable"), F.col("o_orderpriority").alias("version"))
    return tables.complete_sets(rows, ["run"], _SEVEN)


@query("WITH f AS (SELECT o_custkey run, o_orderkey % 7 v, max(o_orderpriority) p FROM orders GROUP BY ALL) SELECT run, " + ", ".join(f"any_value(p) FILTER (v = {i}) v{i}" for i in range(7)) + " FROM f GROUP BY run HAVING count(*) = 7")
def complete_inputs(spark, d):
    """Runs that have all of seven variables, with the latest version of each."""
    return _sets(spark, d)[0]


@query("""WITH k AS (SELECT DISTINCT o_custkey run, 'v' || i v, i FROM orders, (SELECT unnest(range(7)) i))
    SELECT run, string_agg(v, ',' ORDER BY v) missing FROM k WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = run AND o_orderkey % 7 = i) GROUP BY run""")
def incomplete_inputs(spark, d):
    return _sets(spark, d)[1].withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {OCEAN} SELECT cell, lev, y, {R('avg(t)')} t, {R('avg(s)')} s FROM o GROUP BY ALL")
def annual_append(spark, d):
    """Annual means that a stream of lineitem's files keeps up to date: each batch replaces the partitions of the years that it touches."""
    out = tables.new_folder(spark, "annual")
    # as a pattern, since a stream takes a single file by a pattern only
    arrived = spark.readStream.schema(table(spark, d, "lineitem").schema).parquet(f"{d}/lineitem.parquet*").select(F.year("l_shipdate").alias("y"))
    history = lambda years: ocean(spark, d).join(years, "y", "left_semi")
    append_annual_means(arrived, history, f"{out}/rows", f"{out}/progress", ["cell", "lev"], "y", "z", ["t", "s"]).awaitTermination()
    found = spark.read.schema("cell long, lev int, t double, s double, y int").parquet(f"{out}/rows")
    return found.select("cell", "lev", "y", r4("t").alias("t"), r4("s").alias("s"))
