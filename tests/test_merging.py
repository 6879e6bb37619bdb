"""Rules that were mended, merges along an axis, nearest cells, refined migration, exact quantiles, stored tables and merged streams: against brute force and by plan."""

import bisect
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from isolayers.functions.density_grid import Grid
from isolayers.operators import change, columns, emergence, ensemble, merging, repair, selection, sphere, surface, time_space
from isolayers.plans import lookup_queries, more_queries, ocean_queries, statistics_queries
from isolayers.sources import tables
from isolayers.streaming import annual

GRID, DIR = Grid(), "/root/testdata/sf0.001"


def plan_of(df, adaptive="false"):
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


# Rules


def test_only_the_nearest_cell_of_all_is_corrected(spark):
    cells = spark.createDataFrame([(1, 10.0, 100.0, 2), (2, -30.0, 60.0, 3), (3, 40.0, 10.0, 3)], "cell int, lat double, lon double, basin int")
    points = spark.createDataFrame([(10.0, 100.0, 3, 2), (41.0, 11.0, 3, 1), (-31.0, 61.0, None, 9)], "lat double, lon double, before int, after int")
    assert {r.cell: r.basin for r in repair.points_corrected(cells, points).collect()} == {1: 2, 2: 9, 3: 1}
    with pytest.raises(ValueError):
        repair.short(spark.range(11), 10)


def test_years_that_lack_a_month_have_no_annual_values(spark):
    assert {r.y for r in ocean_queries.annual_zonal_bins(spark, DIR).select("y").distinct().collect()} == set(range(1995, 2001))


def test_bins_are_numbered_from_one(spark):
    df = spark.createDataFrame([(1, i, 5.0 + 10 * i, r) for i, r in enumerate((18.9, 19.3, 19.9))], "c int, lev int, z double, rho double")
    got = {r.rho_idx: r.thick for r in columns.density_profile(df, ["c"], "lev", "rho", "z", [], GRID).collect()}
    depth0 = 5 + 10 * 0.1 / 0.4  # of 19.0, which bin 1 is measured from
    assert min(got) == 1 and sum(got.values()) == pytest.approx(25 - depth0)


@pytest.mark.parametrize("noise, toe", [(4e-10, 5), (4e-3, 5), (0.0, 0)])
def test_emergence_whatever_the_unit(spark, noise, toe):
    df = spark.createDataFrame([(1, i, 0.0) for i in range(5)], "k int, t int, x double")
    assert emergence.time_of_emergence(df, ["k"], "t", F.col("x"), F.lit(noise), strict=True).first().toe == toe
    df = spark.createDataFrame([(1, i, 4.1e-10) for i in range(5)], "k int, t int, x double")
    assert emergence.time_of_emergence(df, ["k"], "t", F.col("x"), F.lit(noise), strict=True).first().toe == (0 if noise < 1e-3 else 5)


def test_refill_down_to_the_sea_floor(spark):
    rho = spark.createDataFrame([(1, 0, 30.0), (1, 1, 10.0), (1, 2, 5.0), (1, 3, 0.0)], "k int, rho_idx int, v double")
    z = spark.createDataFrame([(1, 0.0, 25.0), (1, 900.0, 0.0), (1, 1000.0, 20.0)], "k int, z double, v double")
    bottom = spark.createDataFrame([(1, 2000.0)], "k int, bottom double")
    got = {r.rho_idx: r.depth for r in change.volume_refill(rho, z, ["k"], "v", bottom).collect()}
    # 45 below all: the first level; 15: three quarters up from the floor; 5: a quarter
    assert got == {0: 0.0, 1: pytest.approx(1250.0), 2: pytest.approx(1750.0)}
    assert {r.rho_idx: r.depth for r in change.volume_refill(rho, z, ["k"], "v").collect()}[2] == 1000.0


def test_painted_axis(spark):
    depths = spark.createDataFrame([(1, 5, 10.0), (1, 7, 30.0), (1, 6, 40.0), (1, 9, None)], "k int, rho int, d double")
    axis = spark.createDataFrame([(1, float(z), 45.0) for z in (0, 10, 35, 40, 50)] + [(2, 5.0, 45.0)], "k int, z double, bottom double")
    got = {(r.k, r.z): r.rho for r in change.painted(depths, axis, ["k"], "d", "rho", "z", "bottom").collect()}
    assert got == {(1, 0.0): None, (1, 10.0): 5, (1, 35.0): 7, (1, 40.0): 7, (1, 50.0): None, (2, 5.0): None}


def test_windows_of_migration_are_open(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 5.0, 0.0), (1, 5, 0.0, 9.0, 5.0)], "b int, lat int, rho double, x1 double, x2 double")
    assert change.migration(df, ["b"], "lat", "rho", "x1", "x2", 0.01).count() == 0
    assert change.migration_refined(df.withColumn("x2", F.when(F.col("lat") == 5, F.col("x2"))), ["b"], "lat", "rho", "x1", "x2", 0.01).count() == 0


# Merges


@pytest.mark.parametrize("width", [None, 0.7, 1000.0])
def test_neighbours_against_brute_force(spark, width):
    rng = random.Random(5)
    points = [(k, rng.randrange(-300, 300) / 10, i) for k in (1, 2, None) for i in range(0 if k is None else 60)] + [(1, None, 99)]
    points = list({(k, x): (k, x, i) for k, x, i in points}.values())
    asked = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([None, *(rng.randrange(-350, 350) / 10 for _ in range(9))]), f"r{i}") for i in range(200)]
    p, a = spark.createDataFrame(points, "k int, x double, v int"), spark.createDataFrame(asked, "k int, x double, name string")
    got = {r.name: r for r in merging.neighbours(p, a, ["k"], "x", ["v"], width).collect()}
    assert len(got) == 200
    for k, x, name in asked:
        own = sorted((y, v) for j, y, v in points if j == k and y is not None)
        before = own[bisect.bisect_right(own, (x, 1e9)) - 1] if x is not None and own and own[0][0] <= x else None
        at = bisect.bisect_left(own, (x, -1)) if x is not None else 0
        after = own[at] if x is not None and at < len(own) else None
        assert (got[name].before and tuple(got[name].before)) == before and (got[name].after and tuple(got[name].after)) == after
    near = {r.name: (r["at"], r.v) for r in merging.as_of(p, a, ["k"], "x", ["v"], "nearest", width).collect()}
    for k, x, name in asked:
        own = [(abs(y - x), y, v) for j, y, v in points if j == k and y is not None and x is not None]
        assert near[name] == (min(own)[1:] if own else (None, None))


def test_neighbours_of_nothing_and_in_one_hot_key(spark):
    schema = "k int, x double, v int"
    none, some = spark.createDataFrame([], schema), spark.range(3000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x"), F.col("id").cast("int").alias("v"))
    assert merging.neighbours(none, some, ["k"], "x", ["v"], 10.0).where("before IS NOT NULL OR after IS NOT NULL").count() == 0
    assert merging.neighbours(some, none, ["k"], "x", ["v"], 10.0).count() == 0
    asked = some.select("k", (F.col("x") + 0.5).alias("x"))
    got = merging.as_of(some, asked, ["k"], "x", ["v"], width=100.0)
    assert got.where("v = x - 0.5").count() == 3000
    assert re.search(r"hashpartitioning\(k#\d+, _b#\d+", plan_of(got)) and not re.search(r"Window .*_x#\d+ ASC.*hashpartitioning\(k#\d+, 4\)", plan_of(got))  # dealt by key and stretch


def test_irregular_intervals_against_brute_force(spark):
    rng = random.Random(6)
    edges = []
    for k in range(4):
        at = 0.0
        for i in range(60):
            wide = rng.choice([0.1, 0.5, 1.0, 30.0])
            edges.append((k, round(at, 3), round(at + wide, 3), i))
            at += wide * rng.choice([0.5, 1.0, 1.2])  # overlaps and gaps
    edges.append((1, None, 4.0, 1000))
    points = [(rng.randrange(5), round(rng.random() * 300, 3), i) for i in range(500)] + [(0, None, -1)]
    e, p = spark.createDataFrame(edges, "k int, lo double, hi double, e int"), spark.createDataFrame(points, "k int, x double, p int")
    found = merging.in_intervals(p, e, ["k"], "x", "lo", "hi", ["e"])
    want = sorted((p, e) for k, x, p in points for j, lo, hi, e in edges if j == k and x is not None and lo is not None and lo <= x < hi)
    assert sorted((r.p, r.e) for r in found.collect()) == want
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_upper_end_of_closed_intervals(spark):
    e = spark.createDataFrame([(0.0, 1.0, False), (1.0, 2.0, True)], "lo double, hi double, last boolean")
    p = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.1,)], "x double")
    assert sorted((r.x, r.lo) for r in merging.in_intervals(p, e, [], "x", "lo", "hi", [], closed=F.col("last")).collect()) == [(0.0, 0.0), (1.0, 1.0), (2.0, 1.0)]


def test_two_dimensions_are_two_passes_of_one(spark):
    rng = np.random.default_rng(7)
    xs, ys = np.array([0.0, 1.0, 4.0, 9.0]), np.array([-3.0, 0.0, 0.5])
    v = rng.random((4, 3))
    df = spark.createDataFrame([(1, float(x), float(y), float(v[i, j])) for i, x in enumerate(xs) for j, y in enumerate(ys)], "k int, x double, y double, v double")
    places = [(float(a), float(b)) for a, b in zip(rng.random(30) * 9, rng.random(30) * 3.5 - 3)] + [(9.0, 0.5), (0.0, -3.0), (4.0, 0.25), (9.1, 0.0)]
    targets = spark.createDataFrame([(1, *p) for p in places], "k int, x double, y double")
    got = {(r.x, r.y): r.v for r in merging.interpolate_2d(df, ["k"], "x", "y", "v", targets).collect()}
    for a, b in places[:-1]:
        assert got[a, b] == pytest.approx(np.interp(b, ys, [np.interp(a, xs, v[:, j]) for j in range(3)]), rel=1e-12)
    assert got[9.1, 0.0] is None
    holed = df.where("NOT (x = 4 AND y = 0)")
    assert merging.interpolate_2d(holed, ["k"], "x", "y", "v", targets).where("x = 4 AND y = 0.25").first().v is None
    assert merging.interpolate_2d(holed, ["k"], "x", "y", "v", targets, whole=False).where("x = 4 AND y = 0.25").first().v == pytest.approx(v[2, 2])


def test_linear_regrid_over_the_date_line_and_beside_missing_cells(spark):
    source = [(1, 0.0, 0.0, 1.0), (2, 0.0, 120.0, 2.0), (3, 0.0, 240.0, 4.0), (4, 10.0, 0.0, 10.0), (5, 10.0, 120.0, None), (6, 10.0, 240.0, 40.0)]
    s = spark.createDataFrame(source, "cell int, lat double, lon double, v double")
    target = [(1, 0.0, 300.0), (2, 0.0, -60.0), (3, 5.0, 300.0), (4, 5.0, 60.0), (5, 10.0, 120.0), (6, 10.0, 60.0), (7, 11.0, 0.0), (8, 0.0, 0.0), (9, 10.0, 359.999)]
    t = spark.createDataFrame(target, "cell int, lat double, lon double")
    got = {r.cell: r.v for r in time_space.regrid(s, merging.linear_weights(s, t), "cell", [], ["v"]).collect()}
    assert got[1] == got[2] == pytest.approx(2.5) and got[3] == pytest.approx((4 + 1 + 40 + 10) / 4)
    assert got[4] == pytest.approx((1 + 2 + 10) / 3) and got[5] is None and got[6] == pytest.approx(10.0)
    assert 7 not in got and got[8] == 1.0 and got[9] == pytest.approx(10.0, abs=1e-3)
    # an absent cell is like one without a value
    got = {r.cell: r.v for r in time_space.regrid(s.where("cell != 5"), merging.linear_weights(s.where("cell != 5"), t), "cell", [], ["v"]).collect()}
    assert got[4] == pytest.approx((1 + 2 + 10) / 3) and 5 not in got


def test_refined_migration_against_a_refined_grid(spark):
    rng = random.Random(9)
    data = [(b, y, r / 4, 34 + rng.random(), rng.choice([None] + [34 + rng.random() for _ in range(6)])) for b in (1, 2) for y in range(0, 14, 2 if b == 1 else 1) for r in range(4)]
    df = spark.createDataFrame(data, "b int, lat int, rho double, x1 double, x2 double")
    eps, want = 0.03, {}
    for b in (1, 2):
        grid = []
        for r in range(4):
            line = sorted((y, x2) for bb, y, rr, _, x2 in data if bb == b and rr == r / 4)
            for (y, v), after in zip(line, [*line[1:], (None, None)]):
                if v is not None:
                    end = after[0] if after[1] is not None else y
                    grid += [(r / 4, k, v if end == y else v + (k / 100 - y) / (end - y) * (after[1] - v)) for k in range(y * 100, end * 100 + 1)]
        for bb, y, r, x1, _ in data:
            if bb == b:
                near = [(round((k / 100 - y) ** 2 + (rr - r) ** 2, 9), rr, k) for rr, k, v in grid if abs(k / 100 - y) < 5 and abs(rr - r) < 0.5 and abs(v - x1) < eps]
                if near:
                    want[b, y, r] = (y - min(near)[2] / 100, r - min(near)[1])
    found = change.migration_refined(df, ["b"], "lat", "rho", "x1", "x2", eps)
    got = {(r.b, r.lat, r.rho): (r.d_lat, r.d_rho) for r in found.collect()}
    assert got.keys() == want.keys() and len(got) > 40
    assert all(got[k] == (pytest.approx(want[k][0], abs=1e-9), pytest.approx(want[k][1])) for k in want)
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# The sphere


def brute_nearest(source, target, k):
    def unit(lat, lon):
        a, b = math.radians(lat), math.radians(lon)
        return np.array([math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)])

    s = [(c, unit(la, lo)) for c, la, lo in source]
    return {c: [x for _, x in sorted((round(float(np.linalg.norm(unit(la, lo) - u)), 12), x) for x, u in s)[:k]] for c, la, lo in target}


@pytest.mark.parametrize("kind", ["even", "few", "two", "cluster", "grid"])
def test_nearest_cells_against_brute_force(spark, kind):
    rng = random.Random(kind)
    place = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 360))
    if kind == "grid":
        source = [(i * 100 + j, -90.0 + 15 * i, 15.0 * j) for i in range(13) for j in range(24)]
    elif kind == "cluster":
        source = [(i, 10 + rng.random() / 9, 20 + rng.random() / 9) for i in range(100)] + [(100, -80.0, 0.0)]
    else:
        source = [(i, *place()) for i in range({"even": 400, "few": 9, "two": 2}[kind])]
    target = [(1000 + i, *place()) for i in range(60)] + [(1, 90.0, 0.0), (2, -90.0, 50.0), (3, 0.0, 180.0), (4, 0.0, 0.0)]
    schema = "cell int, lat double, lon double"
    found = sphere.nearest_cells(spark.createDataFrame(source, schema), spark.createDataFrame(target, schema), 4)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.dst_cell, r["rank"])):
        got.setdefault(r.dst_cell, []).append(r.src_cell)
    assert got == brute_nearest(source, target, 4)


def test_nearest_cells_take_few_joins_and_candidates(spark):
    schema = "cell long, lat double, lon double"
    place = lambda df, k: df.select(F.col("id").alias("cell"), F.degrees(F.asin(F.rand(k) * 2 - 1)).alias("lat"), (F.rand(k + 1) * 360).alias("lon"))
    s, t = place(spark.range(4000), 1), place(spark.range(500), 5)
    for levels in (6, 12):
        plan = plan_of(sphere.nearest_cells(s, t, 4, levels))
        assert plan.count("Join") == 3
    assert spark.createDataFrame([], schema).count() == 0 and sphere.nearest_cells(spark.createDataFrame([], schema), t).count() == 0
    weights = sphere.inverse_distance_weights(s, t).groupBy("dst_cell").agg(F.count("weight").alias("n"), F.sum("weight").alias("w"))
    assert weights.where("n = 4 AND abs(w - 1) < 1e-9").count() == 500


# Quantiles, tables, ensembles, streams


@pytest.mark.parametrize("most", [0, 7, 100_000])
def test_exact_quantiles(spark, most):
    rng = random.Random(3)
    data = [(1, rng.gauss(0, 1)) for _ in range(400)] + [(2, 5.0)] * 300 + [(2, float(i)) for i in range(9)] + [(3, 1.5)] + [(4, None)] + [(5, 2.0**-i) for i in range(40)] + [(None, float(i)) for i in range(4)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(data, "k int, v double").repartition(3)
    got = {(r.k, r.share): r.v for r in selection.exact_quantiles(df, ["k"], "v", shares, buckets=16, most=most).collect()}
    assert {k for k, _ in got} == {1, 2, 3, 5, None} and len(got) == 30
    for k, q in got:
        own = [v for j, v in data if j == k and v is not None]
        assert got[k, q] == pytest.approx(float(np.quantile(own, q)), rel=1e-12, abs=1e-300)


def test_stored_tables_join_without_a_shuffle(spark, tmp_path):
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select((F.col("id") % 100).alias("cell"), (F.col("id") % 7).cast("int").alias("lev"), F.rand(1).alias("v"))
        run, control, noise = (tables.stored_by_keys(rows.groupBy("cell", "lev").agg(F.avg("v").alias(n)), f"t_{n}", ["cell", "lev"], 4, str(tmp_path / n)) for n in ("run", "control", "noise"))
        found = run.join(control, ["cell", "lev"]).join(noise, ["cell", "lev"]).groupBy("cell", "lev").agg(F.max(F.col("run") - F.col("control")).alias("x"))
        assert "Exchange" not in plan_of(found) and found.count() == 700
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
        for n in ("run", "control", "noise"):
            spark.sql(f"DROP TABLE IF EXISTS t_{n}")


def test_ensemble_in_one_pass(spark):
    data = [(m, p, y, float((m * 7 + p * 3 + y * y) % 11)) for m in range(4) for p in range(5) for y in range(6) if (m + p) % 4 or y < 2]
    df = spark.createDataFrame(data, "m int, p int, y int, v double")
    block = ensemble.ensemble_block(df, ["p"], "m", "y", "v", 4, (0, 3), 60.0, bowl="v")
    plan = plan_of(block)
    assert plan.count("Exchange ") == 1
    got = {(r.p, r.y): r for r in block.collect()}
    present = ensemble.presence(df, ["p", "y"], "v", 4, 60.0)
    anomalies = ensemble.anomaly(df, ["m", "p"], "y", "v", 0, 3)
    want = present.join(ensemble.ensemble_mean(df, ["p", "y"], ["v"]), ["p", "y"]).join(ensemble.sign_agreement(anomalies, ["p", "y"], "anomaly"), ["p", "y"])
    want = want.join(ensemble.model_spread(df, ["p", "y"], "v"), ["p", "y"]).join(ensemble.largest_member_std(df, ["p"], "m", "v"), "p").join(ensemble.bowl_limit(df, ["p"], "y", "v"), "p")
    want = {(r.p, r.y): (r.presence, r.v, r.agree, r.spread, r["std"], r.siglimit) for r in want.collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.presence, r["mean"], r.agree, r.spread, r["std"], r.bowl) == pytest.approx(want[k])


def test_scenarios_and_noise_in_one_pass(spark):
    data = [(m, p, y, None if (m, p, y) == (3, 1, 2) else float((m * 5 + p * 3 + y * y) % 13)) for m in range(6) for p in range(4) for y in range(7) if (m != 5 or y < 4) and (m != 4 or y >= 4) and (p != 2 or m % 2) and (p != 3 or y > 2)]
    df = spark.createDataFrame(data, "m int, p int, y int, v double")
    block = emergence.scenario_block(df, ["m"], ["p"], "y", "v", 4, F.col("m") % 2 == 0, F.col("y") < 2)
    past, later = df.where("y < 4"), df.where("y >= 4")
    want = emergence.signal_of_scenarios(past, past.where("m % 2 = 0"), later, df.where("y < 2"), ["m"], ["p"], "y", "v")
    noise = {n: {r.p: r["std"] for r in ensemble.largest_member_std(rows_, ["p"], "m", "v").collect()} for n, rows_ in ((1, past), (2, later))}
    want = {(r.m, r.p, r.y): (r.signal, noise[1].get(r.p), noise[2].get(r.p)) for r in want.collect()}
    got = {(r.m, r.p, r.y): (r.signal, r.noise1, r.noise2) for r in block.collect()}
    assert got.keys() == want.keys() and {k[0] for k in got} == {0, 1, 2, 3}
    assert {k[1] for k in got if k[2] < 4} == {0, 1, 3} and {k[1] for k in got if k[2] >= 4} == {0, 1, 2}  # no natural run at 2, no control at 3
    assert all(got[k] == pytest.approx(want[k]) if want[k][0] is not None else got[k][0] is None for k in want)
    found = emergence.signal_and_noise(df, ["p"], ["m"], "v", F.col("y") < 2, F.col("y") >= 4)
    level = ensemble.ensemble_mean(df.where("y < 2"), ["p"], ["v"])
    want = {(r.m, r.p, r.y): (r.signal, noise[2][r.p]) for r in emergence.signal_over(df, level, ["p"], "v").collect()}
    got = {(r.m, r.p, r.y): (r.signal, r.noise) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) if want[k][0] is not None else got[k][0] is None for k in want)
    assert plan_of(found).count("Exchange ") == 1 and emergence.signal_and_noise(df.limit(0), ["p"], ["m"], "v").count() == 0


@pytest.mark.parametrize("name, most", [("toe_scenarios", 2), ("toe_box_scenarios", 2), ("scenario_signal", 2), ("toe_box_control", 1), ("toe_ensemble", 1), ("average_toe", 1), ("toe_noise_pairs", 2), ("ens_lines", 2), ("ens_volumes", 2)])
def test_emergence_scans_the_long_table_once(spark, name, most):
    """The second scan tells the runs or their number, from narrow columns."""
    query = (more_queries.QUERIES | statistics_queries.QUERIES)[name]
    assert plan_of(query(spark, DIR)).count("lineitem.parquet") == most


def test_density_is_evaluated_once_per_outcrop(spark):
    plan = plan_of(statistics_queries.QUERIES["outcrop_transformation"](spark, DIR))
    assert not any("4.3159255086706703E-4" in line for line in plan.splitlines() if "Filter" in line) and plan.count("Exchange hashpartitioning") == 1
    df = spark.createDataFrame([(1, 21.0, 5.0, 1.0), (1, None, 7.0, 1.0), (1, 22.05, 2.0, 3.0), (1, 40.0, 4.0, 1.0)], "k int, rho double, f double, a double")
    got = surface.outcrop_transformation(df, ["k"], "rho", ["f"], "a", scale=1.0)
    assert [(r.rho_idx, r.f, r.area) for r in got.orderBy("rho_idx").collect()] == [(0, pytest.approx(60.0), 3.0), (109, pytest.approx(80.0), 1.0)]


def test_all_statistics_take_one_scan_of_the_long_table(spark):
    plan = plan_of(lookup_queries.ens_all_at_once(spark, DIR))
    assert plan.count("lineitem.parquet") == 1


def test_merged_stream_restarts_replays_and_takes_late_months(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "c int, y int, m int, z double, t double, h double"
    data = [(c, y, m, float(m + c), float(c * m), None if (c + m) % 3 == 0 else 1.0) for c in range(3) for y in (2000, 2001) for m in range(1, 13) if (c, m) != (1, 5)]
    data = [d if (d[0], d[2]) != (2, 7) else (*d[:3], 0.0, *d[4:]) for d in data]  # a depth of 0 is no month

    def drop(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        query = annual.merge_annual_bins(stream, out, check, ["c"], "y", "m", "z", ["t"], "h")
        query.awaitTermination()
        return query

    late = [d for d in data if d[2] == 11]
    first, rest = [d for d in data if d[2] <= 5], [d for d in data if d[2] > 5 and d[2] != 11]
    drop(first)
    assert annual.annual_bins_so_far(spark, out, ["c"], "y", "z", ["t"], "h").count() == 0  # no year is whole
    query = drop(rest + first[:7])  # a restart from the checkpoint; some months come again
    assert query.lastProgress["numInputRows"] == len(rest) + 7  # the batch alone is read
    drop(late + [d for d in rest if d[1] == 2000])
    found = annual.annual_bins_so_far(spark, out, ["c"], "y", "z", ["t"], "h")
    want = time_space.annual_bins(spark.createDataFrame(data, schema), ["c", "y"], "z", ["t"], "h")
    key = lambda df: sorted((r.c, r.y, r.z, r.t, r.h, r.pers) for r in df.collect())
    assert key(found) == key(want)
    # a batch that is written again after a failure leaves the same result
    last = spark.read.parquet(f"{out}/_batch=2")
    rows = last.collect()
    spark.createDataFrame(rows, last.schema).write.mode("overwrite").parquet(f"{out}/_batch=2")
    assert key(annual.annual_bins_so_far(spark, out, ["c"], "y", "z", ["t"], "h")) == key(want)


def test_levels_of_a_month_may_come_in_several_batches(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "c int, lev int, y int, m int, t double"
    data = [(c, k, y, m, float(1000 * c + 100 * k + m)) for c in range(3) for k in range(1, 5) for y in (2000, 2001) for m in range(1, 13) if (y, m) != (2001, 12)]
    late = [d for d in data if d[3] == 11 and d[1] > 2]  # the lower half of a column
    again = [(*d[:4], -1.0) for d in data if d[3] == 3]  # comes with other values: the first ones count
    for rows in ([d for d in data if d not in late], late + again, again[:5]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        query = annual.merge_months(stream, out, check, ["c", "lev"], "y", "m", ["t"])
        query.awaitTermination()
        assert query.lastProgress["numInputRows"] == len(rows)  # the batch alone is read
    take = lambda df: sorted((r.c, r.lev, r.y, r.m, r.t) for r in df.collect())
    assert take(annual.months_so_far(spark, out, ["c", "lev"], "y", ["t"], "m")) == sorted(data)
    found = annual.months_so_far(spark, out, ["c", "lev"], "y", ["t"], "m", 12, ["c"], 3)
    assert take(found) == sorted(d for d in data if d[2] == 2000)  # the other year lacks a month
    # columns lie together, so what is made of them needs no further shuffle
    plan = plan_of(columns.valid_columns(found, ["c", "y", "m"], "lev", "t"))
    assert plan.count("hashpartitioning(c#") == 1 and found.rdd.getNumPartitions() == 3


def test_truncated_output_counts_as_not_written(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(3000).select(F.concat(F.lit("m"), F.col("id") % 3).alias("model"), F.rand(1).alias("v"))
    rows.repartition("model").write.partitionBy("model").parquet(path)
    broken = next((tmp_path / "out" / "model=m1").glob("part-*.parquet"))
    broken.write_bytes(broken.read_bytes()[:100])
    catalog = spark.createDataFrame([("m0",), ("m1",), ("m2",), ("m3",)], "model string")
    whole = tables.whole_outputs(spark, path, ["model"], 1000)
    assert sorted(r.model for r in tables.not_written(catalog, whole, ["model"]).collect()) == ["m1", "m3"]


def test_long_sources_of_several_forms(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cell,thetao,so\n1,2.5,35\n2,,34\n")
    (tmp_path / "b.csv").write_text("cell,thetao,so\n3,4.5,33\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    df = tables.read_long(spark, paths, "cell long, thetao double, so double", {"thetao": "t", "so": "s"}, "csv")
    assert sorted(map(tuple, df.collect())) == [(1, 2.5, 35.0), (2, None, 34.0), (3, 4.5, 33.0)] and df.columns == ["cell", "t", "s"]
    df.write.parquet(str(tmp_path / "p"))
    assert tables.read_long(spark, str(tmp_path / "p"), aliases={"t": "x"}).columns == ["cell", "x", "s"]
    df.write.json(str(tmp_path / "j"))
    assert tables.read_long(spark, str(tmp_path / "j"), "cell long, s double", form="json").count() == 3


def test_bowl_edge_of_a_column(spark):
    df = spark.createDataFrame([(1, 10.0, 22.0, 1.0, 2.0), (1, 30.0, 24.0, 3.0, 1.0), (1, 50.0, 24.5, 5.0, 1.0), (2, 10.0, 25.0, 7.0, 1.0)], "c int, z double, rho double, x double, v double")
    got = {(r.c, r.layer, r.below): (r.x, r.spice, r.anomaly) for r in columns.bowl_layers(df, ["c"], "rho", "z", "x", "v", [23.0], 40.0).collect()}
    # the first column's bowl is 24.25, the second's its only level
    mean = (2 + 3 + 5 + 7) / 5
    assert got == {(1, 0, False): (1.0, 0.0, pytest.approx(1 - mean)), (1, 1, False): (3.0, 0.0, pytest.approx(3 - mean)), (1, 1, True): (5.0, -1.0, pytest.approx(5 - mean)), (2, 1, True): (7.0, 1.0, pytest.approx(7 - mean))}


def test_values_just_at_the_tolerance_are_outside(spark):
    """0.1 + 0.2 is over 0.3 by rounding alone: in either order of the sum the point at the tolerance doesn't count."""
    for later in (0.3, 0.1 + 0.2):
        df = spark.createDataFrame([(0, 0.0, 1.0, 0.0, None), (0, 1.0, 1.0, None, later)], "lon int, lat double, r double, x1 double, x2 double")
        for eps in (0.3, 0.1 + 0.2):
            assert change.migration(df, ["lon"], "lat", "r", "x1", "x2", eps).count() == 0
            assert change.migration_refined(df, ["lon"], "lat", "r", "x1", "x2", eps).count() == 0
        assert change.migration(df, ["lon"], "lat", "r", "x1", "x2", 0.31).count() == 1
        assert change.migration_refined(df, ["lon"], "lat", "r", "x1", "x2", 0.31).count() == 1
