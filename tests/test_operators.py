"""Hand-computed cases, hazards and plans."""

import pytest
from pyspark.sql import functions as F

from isolayers.functions.density_grid import SURFACE, Grid
from isolayers.functions.eos import neutral_density
from isolayers.operators import change, columns, emergence, ensemble, repair, time_space
from isolayers.plans.fixture import ocean
from isolayers.sources import tables
from isolayers.streaming import annual

GRID = Grid()


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_check_value(spark):
    rho = spark.range(1).select(neutral_density(F.lit(20.0), F.lit(35.0)).alias("r")).first().r
    assert abs(rho + 1000 - 1024.5941675119673) < 1e-9


def test_grids(spark):
    assert GRID.size == 60 and SURFACE.size == 110
    levels = rows(GRID.table(spark), "rho_idx", "rho", "lo", "hi")
    assert len(levels) == 60 and levels[0][1:3] == (19.0, 0.0) and levels[-1][3] == 50.0
    df = spark.createDataFrame([(18.9,), (19.0,), (19.2,), (26.0,), (28.49,), (28.5,)], "x double")
    assert [r[0] for r in df.select(GRID.bin(F.col("x"))).collect()] == [None, 0, 1, 35, 59, None]


def profile(spark, values):
    return spark.createDataFrame([(1, i, 5.0 + 10 * i, r) for i, r in enumerate(values)], "c int, lev int, z double, rho double")


def test_linear_column(spark):
    got = dict((i, z) for i, z in rows(columns.on_density(profile(spark, [25.0, 26.0, 27.0]), ["c"], "lev", "rho", ["z"], GRID), "rho_idx", "z"))
    assert got[32] == pytest.approx(9.0) and got[40] == pytest.approx(20.0)  # densities 25.4 and 26.5


def test_deepest_crossing_wins(spark):
    got = dict((i, z) for i, z in rows(columns.on_density(profile(spark, [25.0, 26.0, 25.7, 27.0]), ["c"], "lev", "rho", ["z"], GRID), "rho_idx", "z"))
    assert got[34] == pytest.approx(25 + 10 * 0.1 / 1.3)  # 25.8 is crossed twice


def test_flat_column_is_kept_whole(spark):
    assert columns.sub_profile(profile(spark, [25.1, 25.0, 25.2, 25.15]), ["c"], "lev", "rho").count() == 4
    assert columns.sub_profile(profile(spark, [25.1, 25.0, 26.2, 26.15]), ["c"], "lev", "rho").count() == 2


def test_thickness_adds_up(spark):
    got = columns.density_profile(profile(spark, [24.0, 25.5, 26.7, 27.3]), ["c"], "lev", "rho", "z", [], GRID)
    total, deepest = got.agg(F.sum("thick"), F.max("z")).first()
    assert total == pytest.approx(deepest) and deepest == pytest.approx(35.0)


@pytest.mark.parametrize("series, strict, toe", [
    ([0, 0, 0, 0, 0], False, 5), ([3, 3, 3, 3, 3], False, 5), ([3, 3, 3, 3, 3], True, 0), ([0, 3, 0, 3, 3], False, 3), ([3, 3, 3, 3, 0], False, 5), ([None, 3, 3], False, 1),
])
def test_emergence(spark, series, strict, toe):
    df = spark.createDataFrame([(1, i, None if x is None else float(x)) for i, x in enumerate(series)], "k int, t int, x double")
    assert emergence.time_of_emergence(df, ["k"], "t", F.col("x"), F.lit(1.0), strict=strict).first().toe == toe


def test_presence_and_sign(spark):
    df = spark.createDataFrame([(k, float(i)) for k, n in ((1, 49), (2, 50)) for i in range(n)], "k int, x double")
    assert rows(ensemble.presence(df, ["k"], "x", 100), "k") == [(2,)]
    df = spark.createDataFrame([(1, -1.0), (1, 0.0), (1, 2.0)], "k int, x double")
    assert ensemble.sign_agreement(df, ["k"], "x").first().agree == pytest.approx(1 / 3)


def test_box_leaves_out_the_last(spark):
    df = spark.createDataFrame([(1, y, r, float(10 * y + r)) for y in range(1, 5) for r in range(1, 4)], "b int, lat int, rho int, v double")
    box = spark.createDataFrame([(1, 1, 4, 1, 3)], "b int, latmin int, latmax int, rhomin int, rhomax int")
    assert emergence.box_average(df, box, ["b"], ["b"], "lat", "rho", "v").first().v == pytest.approx(21.5)
    assert emergence.box_average(df, box, ["b"], ["b"], "lat", "rho", "v", inclusive=True).first().v == pytest.approx(27.0)


def test_seam(spark):
    df = spark.createDataFrame([(j, i, float(i * i)) for j in range(3) for i in range(8)], "j int, i int, v double")
    got = {(j, i): v for j, i, v in rows(repair.seam_repaired(df, [], "i", "j", "v", 3, 4, 2, 8), "j", "i", "v")}
    assert got[0, 3] == got[0, 4] == (4 + 25) / 2 and got[2, 3] == 9


def test_months(spark):
    df = spark.createDataFrame([(k, m, 1.0) for k, n in ((1, 11), (2, 12)) for m in range(n)], "k int, m int, thick double")
    assert rows(time_space.persistence(df, ["k"], "thick"), "k", "pers") == [(1, pytest.approx(91.6667, abs=1e-3)), (2, 100.0)]


def test_shifted_field_migrates_one_step(spark):
    field = {(y, r): 34 + 0.3 * y + 0.017 * r * r for y in range(8) for r in range(4)}
    data = [(1, y, float(r), field[y, r], field.get((y - 1, r))) for y, r in field]
    df = spark.createDataFrame(data, "b int, lat int, rho double, x1 double, x2 double")
    got = change.migration(df, ["b"], "lat", "rho", "x1", "x2", 0.005, 2, 1.5)
    assert {(r.d_lat, r.d_rho) for r in got.collect()} == {(-1, 0.0)}


def test_empty_and_null_columns(spark):
    empty = profile(spark, []) if False else spark.createDataFrame([], "c int, lev int, z double, rho double")
    assert columns.density_profile(empty, ["c"], "lev", "rho", "z", [], GRID).count() == 0
    nulls = spark.createDataFrame([(1, 0, 5.0, None), (1, 1, 15.0, None)], "c int, lev int, z double, rho double")
    assert columns.density_profile(nulls, ["c"], "lev", "rho", "z", [], GRID).count() == 0


def test_append_replaces_only_its_years(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.append_years(spark.createDataFrame([(1, 1990), (2, 1991)], "v int, y int"), path, ["y"])
    tables.append_years(spark.createDataFrame([(3, 1991)], "v int, y int"), path, ["y"])
    assert rows(spark.read.parquet(path), "y", "v") == [(1990, 1), (1991, 3)]


def test_streamed_years_equal_the_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    data = [(c, y, m, float(m + c), float(c * m)) for c in range(3) for y in (2000, 2001) for m in range(1, 13)]
    schema = "c int, y int, m int, z double, t double"
    for k, part in enumerate((data[:30], data[30:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        history = lambda years: spark.read.schema(schema).parquet(src).join(years, "y", "left_semi")
        annual.append_annual_means(stream, history, out, str(tmp_path / "check"), ["c"], "y", "z", ["t"]).awaitTermination()
    want = time_space.annual_mean(spark.createDataFrame(data, schema), ["c", "y"], "z", ["t"])
    assert rows(spark.read.parquet(out), "c", "y", "t") == rows(want, "c", "y", "t")


def test_plan_has_no_python_and_one_shuffle(spark):
    df = columns.density_profile(ocean(spark, "/root/testdata/sf0.001"), ["cell", "y", "m"], "lev", "rho", "z", ["t", "s"], GRID)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Exchange ") == 1


def test_annual_bins_take_one_scan_and_two_shuffles(spark):
    """One shuffle by column and year serves the levels, the windows, the bins and the annual means; the other the totals. Which years are whole comes from a
    scan of the dates alone and two shuffles of months."""
    from isolayers.plans.ocean_queries import annual

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = annual(spark, "/root/testdata/sf0.001").groupBy("y", "rho_idx").agg(F.avg("t"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("l_quantity" in line for line in scans) == 1 and sum("ReadSchema: struct<l_shipdate:timestamp_ntz>" in line for line in scans) == 1
    assert plan.count("- Exchange ") == 4 and plan.count("BroadcastExchange ") == 1 and "Python" not in plan


def test_half_level_and_flux_of_a_column(spark):
    rows = [(1, i, 5.0 + 10 * i, r, 10.0, v) for i, (r, v) in enumerate(((25.0, 1.0), (26.0, 2.0), (27.0, 4.0)))]
    df = spark.createDataFrame(rows, "c int, lev int, z double, rho double, dz double, v double")
    deep = dict(rows_of(columns.density_profile(df, ["c"], "lev", "rho", "z", [], GRID, dz="dz"), "rho_idx", "z"))
    assert max(deep.items()) == (45, pytest.approx(30.0)) and deep[44] == pytest.approx(24.0)
    got = columns.flux_on_density(df, ["c"], "lev", "rho", "z", F.col("v") * F.col("dz"), GRID)
    flux = dict(rows_of(got, "rho_idx", "flux"))
    # below the levels: 70, 60, 40; below 25.2 (index 31): 68, below 26.0 (35): 60, below 26.9 (44): 42, all of which the bottom keeps
    assert sum(flux.values()) == pytest.approx(70.0) and flux[31] == pytest.approx(2.0) and flux[45] == pytest.approx(42.0)
    total = columns.from_bottom(got, ["c"], "rho_idx", F.col("flux"), "msf").where("rho_idx = 36").first().msf
    assert total == pytest.approx(60.0)  # what the bins above 26.1 don't have


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_conservation_tells_what_is_lost(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0), (3, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 5.0), (2, 0.5)], "k int, v double")
    assert rows(columns.conservation(a, b, ["k"], ["v"]), "k", "kept") == [(1, True), (2, False), (3, False)]


def test_nearest_cells_across_the_pole_and_the_date_line(spark):
    cells = "cell int, lat double, lon double"
    source = spark.createDataFrame([(1, 89.0, 0.0), (2, 89.0, 180.0), (3, 80.0, 0.0), (4, 0.0, 179.5), (5, 0.0, -179.0), (6, 0.0, 170.0), (7, -60.0, 20.0)], cells)
    target = spark.createDataFrame([(10, 89.5, 170.0), (11, 0.0, -179.9), (12, -89.0, 200.0)], cells)
    got = time_space.inverse_distance_weights(source, target, 2, 1.0).collect()
    near = {t: {r.src_cell for r in got if r.dst_cell == t} for t in (10, 11, 12)}
    assert near[10] == {1, 2} and near[11] == {4, 5} and 7 in near[12] and len(near[12]) == 2
    assert all(abs(sum(r.weight for r in got if r.dst_cell == t) - 1) < 1e-12 for t in near)


def test_formation_needs_the_next_bin(spark):
    from isolayers.operators import surface

    df = spark.createDataFrame([(1, 3, 5.0), (1, 4, 2.0), (1, 6, 1.0)], "m int, rho_idx int, f double")
    assert rows_of(surface.formation(df, ["m"], "f").orderBy("rho_idx"), "rho_idx", "formation") == [(3, 3.0), (4, None), (6, None)]
    months = spark.createDataFrame([(m,) for m in range(1, 13)], "m int").orderBy("m")
    assert [r[0] for r in months.select(surface.season(F.col("m"))).collect()] == ["DJF"] * 2 + ["MAM"] * 3 + ["JJA"] * 3 + ["SON"] * 3 + ["DJF"]


def test_refill_keeps_bins_whatever_the_order_of_sums(spark):
    data = [(1, i, 0.1) for i in range(40)]
    rho = spark.createDataFrame(data, "k int, rho_idx int, v double").repartition(3)
    z = spark.createDataFrame([(1, 100.0 * i, 0.1) for i in range(40)], "k int, z double, v double")
    got = rows_of(change.volume_refill(rho, z, ["k"], "v").orderBy("rho_idx"), "rho_idx", "depth")
    assert [g[0] for g in got] == list(range(40)) and all(d == pytest.approx(100 * i) for i, d in got)


def test_ties_at_the_threshold_have_emerged(spark):
    df = spark.createDataFrame([(1, 0, 0.1 + 0.2), (1, 1, 0.3)], "k int, t int, x double")
    assert emergence.time_of_emergence(df, ["k"], "t", F.col("x"), F.lit(0.1) + F.lit(0.2), strict=True).first().toe == 0


def test_last_times_of_the_whole_table(spark):
    df = spark.createDataFrame([(k, t) for k in range(3) for t in range(5 + k)], "k int, t int")
    assert rows(ensemble.time_window(df, "t", last=2), "k", "t") == [(1, 5), (2, 5), (2, 6)]


def test_scenarios_of_runs_with_both_parts(spark):
    run = "r string, p int, y int, v double"
    hist = spark.createDataFrame([("a", 1, 1, 5.0), ("b", 1, 1, 6.0)], run)
    future = spark.createDataFrame([("a", 1, 2, 9.0), ("c", 1, 2, 9.0)], run)
    natural = spark.createDataFrame([("n", 1, 1, 1.0), ("m", 1, 1, 3.0)], run)
    control = spark.createDataFrame([("x", 1, 0, 4.0), ("x", 1, 1, 6.0)], run)
    got = emergence.signal_of_scenarios(hist, natural, future, control, ["r"], ["p"], "y", "v")
    assert rows(got, "r", "y", "signal") == [("a", 1, 3.0), ("a", 2, 4.0)]


def test_refined_axis_and_masks(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 2, 3.0)], "k int, lat int, v double")
    assert rows(change.refined(df, ["k"], "lat", "v", 4), "lat", "v") == [(0.0, 1.0), (0.5, 1.5), (1.0, 2.0), (1.5, 2.5), (2.0, 3.0)]
    df = spark.createDataFrame([(1, z, 1.0) for z in (10.0, 50.0, 90.0)], "k int, z double, v double")
    limits = spark.createDataFrame([(1, 20.0, 60.0)], "k int, top double, bottom double")
    assert rows_of(change.masked_column(df, limits, ["k"], "z", "v", "top", "bottom").orderBy("z"), "v") == [(None,), (1.0,), (None,)]


def test_bottom_of_the_contiguous_levels(spark):
    data = [(1, 1, 1.0), (1, 2, 1.0), (1, 3, None), (1, 4, 1.0), (2, 2, 1.0), (3, 1, 1.0), (4, 1, None)]
    df = spark.createDataFrame(data, "k int, lev int, v double")
    assert rows(columns.bottom_level(df, ["k"], "lev", "v"), "k", "bottom") == [(1, 2), (3, 1)]


def test_complete_sets_tell_what_is_missing(spark):
    data = [(1, "so", "1"), (1, "so", "2"), (1, "vo", "1"), (2, "so", "1"), (3, "vo", None), (4, "other", "1")]
    whole, lacking = tables.complete_sets(spark.createDataFrame(data, "run int, variable string, version string"), ["run"], ["so", "vo"])
    assert rows(whole, "run", "so", "vo") == [(1, "2", "1")]
    assert rows(lacking, "run", "missing") == [(2, ["vo"]), (3, ["so", "vo"])]
