"""Queries over orders, lineitem and events: ensembles, emergence, surface fluxes, catalogs, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.density_grid import SURFACE
from ..functions.eos import density_flux_heat, density_flux_water, haline_contraction, neutral_density, specific_heat, thermal_expansion
from ..operators import columns, emergence, ensemble, surface
from ..operators.change import painted
from ..operators.change import volume_refill as refill
from ..sources import tables
from ..streaming import annual
from .fixture import r4, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def R(x: str) -> str:
    return f"round({x} + 1.3e-7, 4)+0"


# An ensemble: member = supplier / 25, model = its region, point = (lat, part size as density), value = mean price of a year in thousands.
ENS = """e AS (SELECT CAST(l_suppkey // 25 AS INT) member, CAST(n_regionkey AS INT) model, CAST(l_suppkey % 25 AS INT) lat, CAST(p_size AS INT) r, CAST(year(l_shipdate) AS INT) y,
    avg(l_extendedprice)/1000 v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN nation ON n_nationkey = l_suppkey % 25 GROUP BY 1, 2, 3, 4, 5),
    nm AS (SELECT count(DISTINCT l_suppkey // 25) n FROM lineitem)"""


def ens(spark: SparkSession, d: str) -> DataFrame:
    items, part = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", F.col("p_size").alias("r"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("_k"), F.col("n_regionkey").cast("int").alias("model"))
    rows = items.select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("y"), "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(F.broadcast(nation), F.col("l_suppkey") % 25 == F.col("_k"))  # 25 rows
    member, lat = F.floor(F.col("l_suppkey") / 25).cast("int").alias("member"), (F.col("l_suppkey") % 25).cast("int").alias("lat")
    return rows.groupBy(member, "model", lat, F.col("r").cast("int").alias("r"), "y").agg((F.avg("l_extendedprice") / 1000).alias("v"))


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count_distinct(F.floor(F.col("l_suppkey") / 25)).alias("n"))


def _with_members(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return rows.join(F.broadcast(members(spark, d)))  # one row


@query(f"WITH {ENS} SELECT lat, r, y, {R('100e0*count(v)/max(n)')} presence FROM e, nm GROUP BY ALL HAVING 100e0*count(v)/max(n) >= 50")
def ens_presence(spark, d):
    found = ensemble.presence(_with_members(ens(spark, d), spark, d), ["lat", "r", "y"], "v", F.col("n"))
    return found.select("lat", "r", "y", r4("presence").alias("presence"))


@query(f"WITH {ENS} SELECT lat, r, y, {R('sum(v)/max(n)')} v FROM e, nm GROUP BY ALL")
def ens_mean_zero_fill(spark, d):
    found = ensemble.zero_filled_mean(_with_members(ens(spark, d), spark, d), ["lat", "r", "y"], "v", F.col("n"))
    return found.select("lat", "r", "y", r4("v").alias("v"))


@query(f"WITH {ENS}, p AS (SELECT lat, r, y FROM e, nm GROUP BY ALL HAVING 100e0*count(v)/max(n) >= 50) SELECT lat, r, y, {R('avg(v)')} v FROM e SEMI JOIN p USING (lat, r, y) GROUP BY ALL")
def ens_mean_present(spark, d):
    rows = ens(spark, d)
    present = ensemble.presence(_with_members(rows, spark, d), ["lat", "r", "y"], "v", F.col("n"))
    return ensemble.ensemble_mean(rows, ["lat", "r", "y"], ["v"], present).select("lat", "r", "y", r4("v").alias("v"))


@query(f"""WITH {ENS}, a AS (SELECT *, v - avg(v) FILTER (y >= 1995 AND y < 1998) OVER (PARTITION BY member, lat, r) x FROM e)
    SELECT lat, r, y, {R('avg(CASE WHEN x < 0 THEN -1e0 WHEN x >= 0 THEN 1e0 END)')} agree FROM a GROUP BY ALL""")
def ens_sign_agreement(spark, d):
    rows = ensemble.anomaly(ens(spark, d), ["member", "lat", "r"], "y", "v", 1995, 1998, "x")
    return ensemble.sign_agreement(rows, ["lat", "r", "y"], "x").select("lat", "r", "y", r4("agree").alias("agree"))


@query(f"WITH {ENS}, s AS (SELECT lat, r, member, stddev_pop(v) s FROM e GROUP BY ALL) SELECT lat, r, {R('max(s)')} std FROM s GROUP BY ALL")
def ens_std_max(spark, d):
    return ensemble.largest_member_std(ens(spark, d), ["lat", "r"], "member", "v").select("lat", "r", r4("std").alias("std"))


@query(f"WITH {ENS} SELECT lat, r, y, {R('stddev_pop(v)')} spread FROM e GROUP BY ALL")
def ens_model_spread(spark, d):
    return ensemble.model_spread(ens(spark, d), ["lat", "r", "y"], "v").select("lat", "r", "y", r4("spread").alias("spread"))


@query(f"""WITH {ENS}, st AS (SELECT lat, y, avg(r) v FROM e GROUP BY ALL), l AS (SELECT lat, max(v) lim FROM st GROUP BY ALL), q AS (SELECT lat, r, y, avg(v) v FROM e GROUP BY ALL)
    SELECT lat, r, y, {R('CASE WHEN r >= lim THEN v END')} v FROM q LEFT JOIN l USING (lat)""")
def ens_bowl_mask(spark, d):
    rows = ens(spark, d)
    limit = ensemble.bowl_limit(rows, ["lat"], "y", "r", "max")
    means = ensemble.ensemble_mean(rows, ["lat", "r", "y"], ["v"])
    return ensemble.below_bowl(means, limit, ["lat"], "r", "siglimit", ["v"]).select("lat", "r", "y", r4("v").alias("v"))


@query(f"WITH {ENS}, m AS (SELECT r, y, model, avg(v) v FROM e GROUP BY ALL) SELECT r, y, {R('avg(v)')} v FROM m GROUP BY ALL")
def mme_two_level(spark, d):
    return ensemble.two_level_mean(ens(spark, d), ["r", "y"], "model", "v").select("r", "y", r4("v").alias("v"))


@query(f"WITH {ENS}, s AS (SELECT member, min(y) first, max(y) last FROM e GROUP BY ALL) SELECT first, last, count(*) members FROM s GROUP BY ALL")
def ens_time_axes(spark, d):
    return ensemble.unequal_lengths(ens(spark, d), "member", "y")


@query(f"WITH {ENS}, s AS (SELECT lat, r, member, max(y) t FROM e GROUP BY ALL) SELECT lat, r, y, count(*) n FROM e JOIN s USING (lat, r, member) WHERE y > t - 3 GROUP BY ALL")
def ens_last_years(spark, d):
    return ensemble.time_window(ens(spark, d), "y", last=3, keys=["lat", "r", "member"]).groupBy("lat", "r", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ENS}, q AS (SELECT lat, r, avg(v) z FROM e GROUP BY ALL), k AS (SELECT *, lead(z) OVER (PARTITION BY lat ORDER BY r) z2, avg(z) OVER (PARTITION BY lat) bz FROM q)
    SELECT lat, max(r) bowl_rho FROM k WHERE z < bz AND bz <= z2 GROUP BY ALL""")
def bowl_density(spark, d):
    from ..operators.change import without_mean

    rows = ensemble.ensemble_mean(ens(spark, d), ["lat", "r"], ["v"])
    rows = without_mean(rows, ["lat"], "v", "_a").withColumn("bz", F.col("v") - F.col("_a")).drop("_a")
    return ensemble.bowl_density(rows, ["lat"], "r", "v", "bz")


# A signal: per nation and month the orders' mean price in thousands less that of all months; noise: the spread of its first two years.
SIG = """s0 AS (SELECT CAST(c_nationkey AS INT) k, CAST((year(o_orderdate)-1992)*12 + month(o_orderdate) AS INT) t, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/count(*)/100000 v
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    s1 AS (SELECT *, v - avg(v) OVER (PARTITION BY k) x, row_number() OVER (PARTITION BY k ORDER BY t) - 1 i FROM s0),
    nz AS (SELECT k, stddev_pop(v) FILTER (i < 24) n1, stddev_pop(v) n2 FROM s1 GROUP BY k), sg AS (SELECT s1.*, n1, n2 FROM s1 JOIN nz USING (k))"""


def signal(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("k"))
    t = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")).cast("int").alias("t")
    rows = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    months = rows.groupBy("k", t).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 100000).alias("v"))
    w = Window.partitionBy("k")
    months = months.select("*", (F.col("v") - F.avg("v").over(w)).alias("x"), (F.row_number().over(w.orderBy("t")) - 1).alias("i"))
    return months.select("*", F.stddev_pop(F.when(F.col("i") < 24, F.col("v"))).over(w).alias("n1"), F.stddev_pop("v").over(w).alias("n2"))


@query(f"WITH {SIG} SELECT k, CAST(coalesce(max(CASE WHEN NOT coalesce(abs(x) >= (n1)*(1 - 1e-9), false) THEN i END) + 1, count(*)) AS INT) toe FROM sg GROUP BY k")
def toe_point(spark, d):
    return emergence.time_of_emergence(signal(spark, d), ["k"], "i", F.col("x"), F.col("n1"))


@query(f"WITH {SIG} SELECT k, CAST(coalesce(max(CASE WHEN NOT coalesce(abs(x) >= (0.2*CASE WHEN i < 30 THEN n1 ELSE n2 END)*(1 - 1e-9), false) THEN i END) + 1, count(*)) AS INT) toe FROM sg GROUP BY k")
def toe_two_thresholds(spark, d):
    return emergence.time_of_emergence_2(signal(spark, d), ["k"], "i", F.col("x"), F.col("n1"), F.col("n2"), 30, 0.2)


@query(f"""WITH {ENS}, c AS (SELECT lat, r, avg(v) c FROM e GROUP BY ALL), n AS (SELECT lat, r, max(s) s FROM (SELECT lat, r, member, stddev_pop(v) s FROM e GROUP BY ALL) GROUP BY ALL),
    q AS (SELECT member, lat, r, y, v - c x, s, row_number() OVER (PARTITION BY member, lat, r ORDER BY y) - 1 i, mult FROM e JOIN c USING (lat, r) JOIN n USING (lat, r), (SELECT unnest([0.5e0, 1e0]) mult))
    SELECT member, lat, r, mult, CAST(coalesce(max(CASE WHEN NOT coalesce(abs(x) >= (mult*s)*(1 - 1e-9), false) THEN j END) + 1, count(*)) AS INT) toe
    FROM (SELECT *, dense_rank() OVER (PARTITION BY member, lat, r ORDER BY y) - 1 j FROM q) GROUP BY ALL""")
def toe_ensemble(spark, d):
    from pyspark.sql import Window

    rows = emergence.signal_and_noise(ens(spark, d), ["lat", "r"], ["member"], "v", out="x", noise="s")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("member", "lat", "r").orderBy("y")) - 1)
    rows = rows.withColumn("mult", F.explode(F.array(F.lit(0.5), F.lit(1.0))))
    return emergence.time_of_emergence(rows, ["member", "lat", "r", "mult"], "i", F.col("x"), F.col("s") * F.col("mult"))


@query(f"""WITH {SIG}, l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i DESC) rk FROM sg), e AS (SELECT k, avg(x) s, max(n1) n, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END w FROM l WHERE rk <= 5 GROUP BY k)
    SELECT k FROM e WHERE s * w < 0 AND abs(s) > 0.1 * n""")
def toe_reject_sign(spark, d):
    rows = signal(spark, d).withColumn("expected", F.when(F.col("k") % 2 == 0, 1).otherwise(-1))
    return emergence.last_years_disagree(rows, ["k"], "i", "x", "n1", 5, 0.1)


BOX = "bx(model, latmin, latmax, rhomin, rhomax) AS (VALUES (0, 0, 20, 5, 25), (1, 0, 24, 10, 40), (2, 5, 24, 1, 50), (3, 0, 24, 1, 50))"


def boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0, 20, 5, 25), (1, 0, 24, 10, 40), (2, 5, 24, 1, 50), (3, 0, 24, 1, 50)], "model int, latmin int, latmax int, rhomin int, rhomax int")


def _box_sql(src: str, keys: str, value: str = "v") -> str:
    return f"""(SELECT {keys}, avg(u) v FROM (SELECT {keys}, lat, avg({value}) u FROM (SELECT *, max(lat) OVER (PARTITION BY {keys}) lm, max(r) OVER (PARTITION BY {keys}) rm
      FROM {src} JOIN bx USING (model) WHERE lat BETWEEN latmin AND latmax AND r BETWEEN rhomin AND rhomax) WHERE lat < lm AND r < rm GROUP BY {keys}, lat) GROUP BY {keys})"""


@query(f"WITH {ENS}, {BOX} SELECT model, member, y, {R('v')} v FROM {_box_sql('e', 'model, member, y')}")
def box_average(spark, d):
    found = emergence.box_average(ens(spark, d), F.broadcast(boxes(spark)), ["model"], ["model", "member", "y"], "lat", "r", "v")
    return found.select("model", "member", "y", r4("v").alias("v"))


@query(f"WITH {ENS}, {BOX}, sd AS (SELECT model, member, lat, r, stddev_pop(v) v FROM e GROUP BY ALL) SELECT model, member, {R('v')} v FROM {_box_sql('sd', 'model, member')}")
def noise_avg_std(spark, d):
    found = emergence.noise_average_std(ens(spark, d), boxes(spark), ["model"], ["model", "member"], "y", "lat", "r", "v")
    return found.select("model", "member", r4("v").alias("v"))


@query(f"WITH {ENS}, {BOX}, ba AS (SELECT * FROM {_box_sql('e', 'model, member, y')}) SELECT model, member, {R('stddev_pop(v)')} v FROM ba GROUP BY ALL")
def noise_std_avg(spark, d):
    found = emergence.noise_std_average(ens(spark, d), boxes(spark), ["model"], ["model", "member"], "y", "lat", "r", "v")
    return found.select("model", "member", r4("v").alias("v"))


@query(f"""WITH {ENS}, {BOX}, ba AS (SELECT * FROM {_box_sql('e', 'model, member, y')}), ct AS (SELECT model, y, avg(v) c FROM ba GROUP BY ALL),
    nz AS (SELECT model, max(s) s FROM (SELECT model, member, stddev_pop(v) s FROM ba GROUP BY ALL) GROUP BY ALL), q AS (SELECT model, member, y - 1995 i, v - c x, s FROM ba JOIN ct USING (model, y) JOIN nz USING (model))
    SELECT model, member, CAST(coalesce(max(CASE WHEN NOT coalesce(abs(x) >= (0.3*s)*(1 - 1e-9), false) THEN i END) - min(i) + 1, count(*)) AS INT) toe FROM q GROUP BY ALL""")
def toe_box_hist_nat(spark, d):
    keys = ["model", "member"]
    means = emergence.box_average(ens(spark, d), boxes(spark), ["model"], [*keys, "y"], "lat", "r", "v")
    control = means.groupBy("model", "y").agg(F.avg("v").alias("v"))
    noise = ensemble.largest_member_std(means, ["model"], "member", "v", out="s")
    rows = emergence.signal_over(means, control, ["model", "y"], "v").join(noise, "model").withColumn("i", F.col("y") - 1995)
    return emergence.time_of_emergence(rows, keys, "i", F.col("signal"), F.col("s"), 0.3)


RUNS = "ru AS (SELECT CAST(o_custkey % 7 AS INT) model, CAST(c_nationkey % 5 AS INT) basin, CAST(round(o_totalprice/1000) AS INT) toe FROM orders JOIN customer ON o_custkey = c_custkey)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 5).cast("int").alias("basin"))
    rows = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select((F.col("o_custkey") % 7).cast("int").alias("model"), "basin", F.round(F.col("o_totalprice") / 1000).cast("int").alias("toe"))


@query(f"""WITH {RUNS}, m AS (SELECT basin, model, median(toe) m FROM ru GROUP BY ALL), a AS (SELECT basin, round_even(median(m), 0) median_of_medians FROM m GROUP BY ALL), b AS (SELECT basin, round_even(median(toe), 0) median_of_all FROM ru GROUP BY ALL)
    SELECT basin, median_of_medians, median_of_all FROM a JOIN b USING (basin)""")
def median_of_medians(spark, d):
    return emergence.median_of_medians(runs(spark, d), "model", ["basin"], "toe")


@query(f"WITH {RUNS} SELECT basin, CAST(CASE WHEN toe = 500 THEN 9 ELSE toe // 50 END AS INT) bin, count(*) n FROM ru WHERE toe >= 0 AND toe <= 500 GROUP BY ALL")
def toe_histogram(spark, d):
    return emergence.histogram(runs(spark, d), ["basin"], "toe", 0.0, 50.0, 10)


@query(f"WITH {RUNS} SELECT basin, quantile_cont(toe, 0.25) q25, quantile_cont(toe, 0.5) q50, quantile_cont(toe, 0.75) q75 FROM ru GROUP BY ALL")
def toe_quartiles(spark, d):
    return emergence.quartiles(runs(spark, d), ["basin"], "toe")


@query(f"WITH {RUNS} SELECT basin, {R('avg(CASE WHEN toe <= 200 THEN toe END)')} mean, {R('stddev_pop(CASE WHEN toe <= 200 THEN toe END)')} std FROM ru GROUP BY ALL")
def noise_summary(spark, d):
    return emergence.noise_summary(runs(spark, d), ["basin"], "toe", 200.0).select("basin", r4("mean").alias("mean"), r4("std").alias("std"))


@query(f"""WITH {ENS}, a AS (SELECT *, v - avg(v) FILTER (y >= 1995 AND y < 1998) OVER (PARTITION BY member, lat, r) x FROM e), g AS (SELECT r, y, avg(CASE WHEN x < 0 THEN -1e0 WHEN x >= 0 THEN 1e0 END) agree FROM a GROUP BY ALL)
    SELECT r, CAST(coalesce(max(CASE WHEN NOT coalesce(abs(agree) >= (0.1)*(1 - 1e-9), false) THEN y END) - min(y) + 1, count(*)) AS INT) toe FROM g GROUP BY r""")
def agreement_detection(spark, d):
    rows = ensemble.sign_agreement(ensemble.anomaly(ens(spark, d), ["member", "lat", "r"], "y", "v", 1995, 1998, "x"), ["r", "y"], "x")
    return emergence.agreement_detection(rows, ["r"], "y", "agree", 0.1)


@query(f"""WITH {ENS}, a AS (SELECT member, lat, y, avg(v) v FROM e WHERE r <= 25 GROUP BY ALL), b AS (SELECT member, lat, y + 7 y, avg(v) v FROM e WHERE r > 40 GROUP BY ALL)
    SELECT member, lat, y, {R('v')} v FROM (SELECT * FROM a SEMI JOIN b USING (member, lat) UNION ALL SELECT * FROM b SEMI JOIN a USING (member, lat))""")
def runs_concatenated(spark, d):
    rows = ens(spark, d)
    part = lambda c: rows.where(c).groupBy("member", "lat", "y").agg(F.avg("v").alias("v"))
    found = emergence.concatenated(part(F.col("r") <= 25), part(F.col("r") > 40), ["member", "lat"], "y", 7)
    return found.select("member", "lat", "y", r4("v").alias("v"))


# Sea-surface fields of an order: temperature from the date, salinity from the price, heat from the customer's balance.
SURF = """sf AS (SELECT CAST(c_nationkey AS INT) k, CAST(month(o_orderdate) AS INT) m, CAST(c_nationkey AS INT) - 12 lat, 2e0 + (o_orderkey % 280)/10e0 t, 33e0 + (o_custkey % 40)/10e0 s, c_acctbal/100 q, (o_orderkey % 7 - 3)*1e-5 w, 1e0 + o_custkey % 3 a
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
CP_SQL = "(4217.4e0+(-3.720283e0+(0.1412855e0+(-2.654387e-3+2.093236e-5*t)*t)*t)*t)+(-7.643575e0+(0.1072763e0-1.38385e-3*t)*t)*s+(0.1770383e0+(-4.07718e-3+5.148e-5*t)*t)*s*sqrt(s)"
BETA_SQL = "((0.785567e-3+(-0.301985e-5+(0.555579e-7-0.415613e-9*t)*t)*t)+(-0.356603e-6+0.788212e-8*t)*(s-35)+0.515032e-8*(s-35)*(s-35))"
ALPHA_SQL = f"(((0.665157e-1+(0.170907e-1+(-0.203814e-3+(0.298357e-5-0.255019e-7*t)*t)*t)*t)+(0.378110e-2-0.846960e-4*t)*(s-35)-0.678662e-5*(s-35)*(s-35))*{BETA_SQL})"


def fields(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("k"), "c_acctbal")
    rows = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        "k", F.month("o_orderdate").alias("m"), (F.col("k") - 12).alias("lat"), (2.0 + (F.col("o_orderkey") % 280) / 10.0).alias("t"), (33.0 + (F.col("o_custkey") % 40) / 10.0).alias("s"),
        (F.col("c_acctbal") / 100).alias("q"), ((F.col("o_orderkey") % 7 - 3) * 1e-5).alias("w"), (1.0 + F.col("o_custkey") % 3).alias("a"),
    ).withColumn("rho", neutral_density(F.col("t"), F.col("s")))


def _rho_sql() -> str:
    from .fixture import RHO_SQL

    return RHO_SQL


@query(f"WITH {SURF} SELECT k, m, round(sum({CP_SQL}), 2)+0 cp, round(sum({BETA_SQL})*1e3 + 1.3e-7, 4)+0 beta, round(sum({ALPHA_SQL})*1e3 + 1.3e-7, 4)+0 alpha FROM sf GROUP BY k, m")
def seawater_properties(spark, d):
    t, s = F.col("t"), F.col("s")
    sums = F.sum(specific_heat(t, s)).alias("cp"), F.sum(haline_contraction(t, s)).alias("beta"), F.sum(thermal_expansion(t, s)).alias("alpha")
    return fields(spark, d).groupBy("k", "m").agg(*sums).select("k", "m", (F.round("cp", 2) + 0.0).alias("cp"), r4(F.col("beta") * 1e3).alias("beta"), r4(F.col("alpha") * 1e3).alias("alpha"))


def _transformed_sql() -> str:
    bin_ = "CASE WHEN rho >= 29 THEN 109 WHEN rho < 25 THEN CAST(floor(round((rho-22e0)/0.1e0, 9)) AS INT) ELSE 30 + CAST(floor(round((rho-25e0)/0.05e0, 9)) AS INT) END"
    return f"""{SURF}, d0 AS (SELECT *, {_rho_sql()} rho FROM sf), d1 AS (SELECT *, -({ALPHA_SQL})/({CP_SQL})*q h, (rho+1000)*{BETA_SQL}*w*1e-3*s f, {bin_} b FROM d0),
    tr AS (SELECT m, b rho_idx, sum(h*a)/(CASE WHEN b < 30 THEN 0.1e0 ELSE 0.05e0 END)*1e6 heat, sum(f*a)/(CASE WHEN b < 30 THEN 0.1e0 ELSE 0.05e0 END)*1e6 water, sum(a) area FROM d1 WHERE b BETWEEN 0 AND 109 GROUP BY m, b)"""


def transformed(spark: SparkSession, d: str) -> DataFrame:
    t, s = F.col("t"), F.col("s")
    rows = fields(spark, d).withColumn("heat", density_flux_heat(F.col("q"), t, s)).withColumn("water", density_flux_water(F.col("w"), t, s))
    return surface.outcrop_transformation(rows, ["m"], "rho", ["heat", "water"], "a", SURFACE, 1e6)


@query(f"WITH {_transformed_sql()} SELECT m, rho_idx, {R('heat')} heat, {R('water')} water, area FROM tr")
def outcrop_transformation(spark, d):
    return transformed(spark, d).select("m", "rho_idx", r4("heat").alias("heat"), r4("water").alias("water"), "area")


@query(f"WITH {_transformed_sql()} SELECT m, rho_idx, {R('CASE WHEN lead(rho_idx) OVER (PARTITION BY m ORDER BY rho_idx) = rho_idx + 1 THEN heat+water - lead(heat+water) OVER (PARTITION BY m ORDER BY rho_idx) END')} formation FROM tr")
def formation(spark, d):
    rows = transformed(spark, d).withColumn("total", F.col("heat") + F.col("water"))
    return surface.formation(rows, ["m"], "total").select("m", "rho_idx", r4("formation").alias("formation"))


@query(f"""WITH {SURF}, x AS (SELECT m, q, a, unnest(list_filter(['global', CASE WHEN lat > 0 THEN 'north' END, CASE WHEN lat > 40 THEN 'north40' END, CASE WHEN lat < 0 THEN 'south' END], lambda z: z IS NOT NULL)) AS "domain" FROM sf)
    SELECT m, "domain", round(sum(q*a), 2)+0 q FROM x GROUP BY ALL""")
def flux_integrals(spark, d):
    return surface.domain_integrals(fields(spark, d), ["m"], "lat", "q", "a").select("m", "domain", (F.round("q", 2) + 0.0).alias("q"))


# A catalog of files: names with a version, made from orders and customers.
FILES = """fi AS (SELECT DISTINCT 'cmip5.model' || (o_custkey % 50) || '.historical.r' || (o_orderkey % 9) || 'i1p1.an.ocn.Omon.' || CASE WHEN o_custkey % 3 = 0 THEN 'so' ELSE 'thetao' END || '.ver-' || (o_custkey % 4) || '.nc' file FROM orders),
    ca AS (SELECT file, split_part(file, '.', 2) model, split_part(file, '.', 4) member, split_part(file, '.', 8) variable, regexp_extract(file, 'ver-([^.]+)', 1) version FROM fi),
    la AS (SELECT model, member, variable, max(version) version FROM ca GROUP BY ALL)"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    name = F.concat(F.lit("cmip5.model"), k % 50, F.lit(".historical.r"), o % 9, F.lit("i1p1.an.ocn.Omon."), F.when(k % 3 == 0, "so").otherwise("thetao"), F.lit(".ver-"), k % 4, F.lit(".nc"))
    return tables.parsed_catalog(table(spark, d, "orders").select(name.alias("file")).distinct())


def latest(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest_version(catalog(spark, d), ["model", "member", "variable"], "version").select("model", "member", "variable", "version")


@query(f"WITH {FILES} SELECT * FROM la")
def latest_version(spark, d):
    return latest(spark, d)


def _two(spark, d):
    rows = latest(spark, d)
    side = lambda v: rows.where(F.col("variable") == v).select("model", "member", F.col("version").alias(f"version_{v}"))
    return side("so"), side("thetao").where("version_thetao != '2'")  # so that some have no partner


@query(f"WITH {FILES} SELECT model, member, a.version version_so, b.version version_thetao FROM la a JOIN la b USING (model, member) WHERE a.variable = 'so' AND b.variable = 'thetao' AND b.version <> '2'")
def pair_inputs(spark, d):
    return tables.paired(*_two(spark, d), ["model", "member"])[0]


@query(f"WITH {FILES} SELECT model, member FROM la WHERE variable = 'so' AND (model, member) NOT IN (SELECT (model, member) FROM la WHERE variable = 'thetao' AND version <> '2')")
def unmatched_inputs(spark, d):
    return tables.paired(*_two(spark, d), ["model", "member"])[1].select("model", "member")


@query(f"WITH {FILES} SELECT DISTINCT model FROM ca WHERE member = 'r1i1p1' AND model IN (SELECT model FROM ca WHERE member = 'r2i1p1')")
def runs_in_both(spark, d):
    rows = catalog(spark, d)
    second = rows.where("member = 'r2i1p1'").select("model").distinct()
    return rows.where("member = 'r1i1p1'").select("model").distinct().join(second, "model", "left_semi")


@query(f"WITH {FILES} SELECT model, member, variable FROM la WHERE (model, member) NOT IN (SELECT (model, member) FROM la WHERE version = '3')")
def work_left(spark, d):
    rows = latest(spark, d)
    return tables.not_written(rows, rows.where("version = '3'"), ["model", "member"]).select("model", "member", "variable")


@query("""WITH l AS (SELECT s_suppkey % 180 - 90 lat, s_suppkey * 7 % 360 lon, s_nationkey a, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 11 END b FROM supplier)
    SELECT CAST(lat AS DOUBLE) lat, CAST(lon AS DOUBLE) lon, CAST(unnest([0, 1]) AS INT) lev, CAST(unnest([a, b]) AS INT) v FROM l""")
def mask_lines_to_grid(spark, d):
    k = F.col("s_suppkey")
    last = F.when(k % 5 == 0, "").otherwise((k % 11).cast("string"))
    lines = table(spark, d, "supplier").select(F.concat_ws(",", k % 180 - 90, k * 7 % 360, "s_nationkey", last).alias("value"))
    return tables.mask_lines(lines)


@query("SELECT date_trunc('hour', ts) AS \"hour\", event_type, count(*) n, round(avg(value) + 1.3e-7, 4)+0 mean_value FROM events GROUP BY ALL")
def events_hourly(spark, d):
    found = annual.hourly(table(spark, d, "events"))
    return found.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", r4("mean_value").alias("mean_value"))


# Two volume distributions per cell, over part size (as density) and over line number (as depth); the sea floor lies 100 below the last line.
_REFILL = """a AS (SELECT l_suppkey k, CAST(p_size AS INT) rho_idx, sum(l_quantity) v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), z AS (SELECT l_suppkey k, l_linenumber*100e0 z, sum(l_quantity) v FROM lineitem GROUP BY ALL),
    rl AS (SELECT k, rho_idx, sum(v) OVER (PARTITION BY k ORDER BY rho_idx DESC) x FROM a),
    rk AS (SELECT k, z, sum(v) OVER (PARTITION BY k ORDER BY z DESC) x FROM z UNION ALL SELECT k, max(z) + 100, 0e0 FROM z GROUP BY k),
    seg AS (SELECT k, x x0, z z0, lead(x) OVER w x1, lead(z) OVER w z1 FROM rk WINDOW w AS (PARTITION BY k ORDER BY x)),
    rd AS (SELECT rl.k, rho_idx, CASE WHEN x1 IS NULL THEN z0 ELSE z0 + (x - x0)/(x1 - x0)*(z1 - z0) END d FROM rl JOIN seg ON seg.k = rl.k AND x >= x0 AND (x < x1 OR x1 IS NULL))"""


def _refilled(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_partkey", (F.col("l_linenumber") * 100.0).alias("z"), F.col("l_quantity").alias("v"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("int").alias("rho_idx"))
    by_rho = items.join(part, "l_partkey").groupBy("k", "rho_idx").agg(F.sum("v").alias("v"))
    by_z = items.groupBy("k", "z").agg(F.sum("v").alias("v"))
    return refill(by_rho, by_z, ["k"], "v", by_z.groupBy("k").agg((F.max("z") + 100).alias("bottom"))), by_z


@query(f"WITH {_REFILL} SELECT k, rho_idx, {R('d')} \"depth\" FROM rd")
def volume_refill(spark, d):
    return _refilled(spark, d)[0].select("k", "rho_idx", r4("depth").alias("depth"))


@query(f"""WITH {_REFILL}, ax AS (SELECT k, max(z) + 50 bottom, unnest(range(0, 900, 50)) z FROM z GROUP BY k)
    SELECT ax.k, CAST(ax.z AS DOUBLE) z, CAST(max(CASE WHEN ax.z <= bottom THEN rho_idx END) AS INT) rho_idx FROM ax LEFT JOIN rd ON rd.k = ax.k AND round(rd.d, 9) <= ax.z GROUP BY ALL""")
def depth_axis_painted(spark, d):
    """The isopycnal at each depth of an axis, down to the column's bottom."""
    depths, levels = _refilled(spark, d)
    axis = levels.groupBy("k").agg((F.max("z") + 50).alias("bottom")).select("k", "bottom", F.explode(F.sequence(F.lit(0), F.lit(850), F.lit(50))).alias("z"))
    axis = axis.withColumn("z", F.col("z").cast("double"))
    found = painted(depths.withColumn("depth", F.round("depth", 9)), axis, ["k"], "depth", "rho_idx", "z", "bottom")
    return found.select("k", "z", "rho_idx")


@query("""WITH p AS (SELECT l_suppkey k, CAST(l_linenumber AS DOUBLE) x, avg(l_tax) v FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL), t AS (SELECT DISTINCT l_suppkey k, unnest([0.5e0, 1, 2.25e0, 4, 6.5e0, 9]) x FROM lineitem),
    q AS (SELECT t.k, t.x, max(CASE WHEN p.x <= t.x THEN p.x END) a, min(CASE WHEN p.x >= t.x THEN p.x END) b, arg_max(v, CASE WHEN p.x <= t.x THEN p.x END) va, arg_min(v, CASE WHEN p.x >= t.x THEN p.x END) vb FROM t JOIN p USING (k) GROUP BY ALL)
    SELECT k, x, round(CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b THEN va ELSE va+(x-a)/(b-a)*(vb-va) END + 1.3e-9, 6)+0 v FROM q""")
def interpolate_at_levels(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").cast("double").alias("x"), "l_tax")
    points = rows.where(F.col("x") % 2 == 1).groupBy("k", "x").agg(F.avg("l_tax").alias("v"))
    targets = rows.select("k").distinct().withColumn("x", F.explode(F.array(*(F.lit(t) for t in (0.5, 1.0, 2.25, 4.0, 6.5, 9.0)))))
    return columns.at_levels(points, ["k"], "x", ["v"], targets, "x").select("k", "x", (F.round(F.col("v") + 1.3e-9, 6) + 0.0).alias("v"))
