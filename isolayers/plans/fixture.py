"""An ocean-like table derived from lineitem, the same in Spark and in DuckDB's SQL.

A column is (cell, y, m); cells grow with the suppliers. lat is cell % 25 (a nation, whose region is the basin), lon and member are cell / 25.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.density_grid import Grid
from ..functions.eos import neutral_density

GRID = Grid()
KEYS = ["cell", "y", "m"]
DEPTHS = (5.0, 25.0, 75.0, 200.0, 500.0, 1200.0, 2500.0)
#: Items in a part of the dealt table. A task sorts the levels and holds the bins of its part, so parts grow in number and not in size.
ITEMS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(x: Column | str) -> Column:
    """Rounded to four decimals, without a negative zero; a small offset keeps exact ties off the edge."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1.3e-7, 4) + F.lit(0.0)


def parts(items: DataFrame, most: int = ITEMS) -> int:
    """Parts for a table dealt by its columns: one per core at least, and no more than `most` rows in each on average."""
    return max(items.sparkSession.sparkContext.defaultParallelism, math.ceil(items.count() / most))


def full_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y) of the years that have all twelve months; the rest of the time axis gives no annual values."""
    months = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).distinct()
    return months.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where("n = 12").select("y")


def ocean(spark: SparkSession, sf_dir: str, cells: int | None = None, whole_years: bool = False) -> DataFrame:
    """With `cells`, suppliers share that many cells, whose columns have all months; with whole_years, years that lack a month are left out."""
    cell = F.col("l_suppkey") % cells if cells else F.col("l_suppkey")
    whole = table(spark, sf_dir, "lineitem")
    items = whole.withColumn("y", F.year("l_shipdate"))
    if whole_years:
        items = items.join(F.broadcast(full_years(spark, sf_dir)), "y", "left_semi")  # a row per year
    items = items.select(
        cell.alias("cell"), "y", F.month("l_shipdate").alias("m"), F.col("l_linenumber").alias("lev"),
        "l_quantity", F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
    )
    # dealt by cell and year before the aggregate, so that it, the windows of a column and the means of a year share one shuffle
    # (few cells are summed before they are dealt)
    sums = (items if cells else items.repartition(parts(whole), "cell", "y")).groupBy(*KEYS, "lev").agg(F.sum("l_quantity").alias("q"), F.sum("tax").alias("tax"), F.count(F.lit(1)).alias("n"))
    z = F.element_at(F.array(*(F.lit(d) for d in DEPTHS)), F.col("lev"))
    t = 34.0 - 4.0 * F.col("lev") + (F.col("q") / F.col("n") - 25.5) / 25.0
    s = 33.25 + 0.25 * F.col("lev") + F.col("tax") / F.col("n").cast("double") / 20.0
    df = sums.select(*KEYS, "lev", z.alias("z"), t.alias("t"), s.alias("s"))
    return df.withColumn("rho", neutral_density(F.col("t"), F.col("s")))


def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lat, basin): one row per nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("lat"), F.col("r_name").alias("basin"))


def with_basin(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = (F.col("cell") % 25).cast("int")
    return df.withColumn("lat", lat).join(F.broadcast(basins(spark, sf_dir)), "lat")  # 25 rows


RHO_SQL = """((1002.3063688892480e0+(2.2280832068441331e-1+(8.1157118782170051e-2+(-4.3159255086706703e-4)*t)*t)*t)
  + ((-1.0304537539692924e-4)+(-3.1710675488863952e-3)*t+(-1.7052298331414675e-7)*s)*s)
 /((1e0+(4.3907692647825900e-5+(7.8717799560577725e-5+((-1.6212552470310961e-7)+(-2.3850178558212048e-9)*t)*t)*t)*t)
  + ((-5.1268124398160734e-4)+(6.0399864718597388e-6+(-2.2744455733317707e-9)*t*t)*t)*s
  + ((-3.6138532339703262e-5)+(-1.3409379420216683e-9)*t*t)*s*sqrt(s)) - 1000e0"""

OCEAN = f"""li AS (SELECT CAST(l_suppkey AS BIGINT) cell, CAST(year(l_shipdate) AS INT) y, CAST(month(l_shipdate) AS INT) m, CAST(l_linenumber AS INT) lev,
  sum(l_quantity) q, CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS DOUBLE) tax, CAST(count(*) AS DOUBLE) n FROM lineitem GROUP BY 1, 2, 3, 4),
o0 AS (SELECT cell, y, m, lev, [5e0,25,75,200,500,1200,2500][lev] z, 34e0-4e0*lev+(q/n-25.5e0)/25e0 t, 33.25e0+0.25e0*lev+tax/n/20e0 s FROM li),
o AS (SELECT *, {RHO_SQL} rho FROM o0)"""
BASIN = "b AS (SELECT CAST(n_nationkey AS INT) lat, r_name basin FROM nation JOIN region ON n_regionkey = r_regionkey)"


def place_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 26 THEN round(({x}-19e0)/0.2e0, 9) ELSE 35+round(({x}-26e0)/0.1e0, 9) END)"


def value_sql(i: str) -> str:
    return f"(CASE WHEN {i} < 35 THEN 19e0+{i}*0.2e0 ELSE 26e0+({i}-35)*0.1e0 END)"


def sub_sql(src: str = "o") -> str:
    return f"""p1 AS (SELECT *, min(rho) OVER w mn, max(rho) OVER w mx, arg_max(rho, lev) OVER w - arg_min(rho, lev) OVER w e FROM {src} WINDOW w AS (PARTITION BY cell, y, m)),
p2 AS (SELECT *, max(CASE WHEN rho = mn THEN lev END) OVER w ll, min(CASE WHEN rho = mx THEN lev END) OVER w dl FROM p1 WINDOW w AS (PARTITION BY cell, y, m)),
sub AS (SELECT cell, y, m, lev, z, t, s, rho FROM p2 WHERE e < 0.2 OR lev BETWEEN ll AND dl)"""


def on_density_sql(src: str) -> str:
    return f"""n1 AS (SELECT *, lead(rho) OVER w r2, lead(z) OVER w z2, lead(t) OVER w t2, lead(s) OVER w s2 FROM {src} WINDOW w AS (PARTITION BY cell, y, m ORDER BY lev)),
n2 AS (SELECT *, unnest(generate_series(greatest(CAST(ceil({place_sql('rho')}) AS INT), 0), least(CAST(ceil({place_sql('r2')}) AS INT) - 1, 59))) i FROM n1 WHERE r2 > rho),
n3 AS (SELECT *, ({value_sql('i')}-rho)/(r2-rho) k FROM n2),
ins AS (SELECT cell, y, m, CAST(i AS INT) rho_idx, arg_max(z+k*(z2-z), lev) z, arg_max(t+k*(t2-t), lev) t, arg_max(s+k*(s2-s), lev) s FROM n3 GROUP BY cell, y, m, i)"""


BOTTOM = f"""bot AS (SELECT cell, y, m, greatest(CAST(ceil({place_sql('max(rho)')}) AS INT), 0) rho_idx, arg_max(z, (rho, lev)) z, arg_max(t, (rho, lev)) t, arg_max(s, (rho, lev)) s
  FROM sub GROUP BY cell, y, m HAVING greatest(CAST(ceil({place_sql('max(rho)')}) AS INT), 0) < 60)"""
PROFILE = f"""{OCEAN}, {sub_sql()}, {on_density_sql('sub')}, {BOTTOM},
u AS (SELECT cell, y, m, rho_idx, arg_max(t, z) t, arg_max(s, z) s, max(z) z FROM (SELECT * FROM ins UNION ALL BY NAME SELECT * FROM bot) GROUP BY cell, y, m, rho_idx),
prof AS (SELECT * FROM (SELECT *, z - coalesce(lag(z) OVER (PARTITION BY cell, y, m ORDER BY rho_idx), 0) thick FROM u) WHERE thick > 0 AND thick < 6000 AND rho_idx > 0)"""
ANNUAL = """fy AS (SELECT CAST(year(l_shipdate) AS INT) y FROM lineitem GROUP BY 1 HAVING count(DISTINCT month(l_shipdate)) = 12), ann AS (SELECT cell, y, rho_idx, sum(z)/nullif(count(CASE WHEN z<>0 THEN 1 END),0) z, sum(t)/nullif(count(CASE WHEN z<>0 THEN 1 END),0) t,
  sum(s)/nullif(count(CASE WHEN z<>0 THEN 1 END),0) s, sum(thick)/nullif(count(CASE WHEN z<>0 THEN 1 END),0) thick, 100e0*count(thick)/12 pers FROM prof SEMI JOIN fy USING (y) GROUP BY cell, y, rho_idx)"""
