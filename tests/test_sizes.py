"""What has to hold at any size: parts that stay small, bins that travel once, no state and no broadcast that grows."""

import random

import pytest

from isolayers.functions.density_grid import Grid
from isolayers.operators import columns, sphere, time_space
from isolayers.plans import fixture, lookup_queries, more_queries, ocean_queries

DIR = "/root/testdata/sf0.001"
GRID = Grid()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_the_items(spark, monkeypatch):
    n = fixture.table(spark, DIR, "lineitem").count()
    monkeypatch.setattr(fixture, "parts", lambda items, most=100, of=fixture.parts: of(items, most))
    assert fixture.parts(fixture.table(spark, DIR, "lineitem")) == -(-n // 100)
    assert fixture.ocean(spark, DIR).rdd.getNumPartitions() == -(-n // 100)
    assert ocean_queries.profile(spark, DIR).rdd.getNumPartitions() == -(-n // 100)


def test_bowl_and_heights_read_their_bins_once(spark):
    found = more_queries.layer_heights(spark, DIR), time_space.bowl(ocean_queries.annual(spark, DIR), ["cell", "y"], "pers", "z", ["t"])
    for df in found:
        plan = plan_of(df)
        assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(cell") == 1


def test_many_cells_at_one_place_are_asked_once(spark):
    rows = [(i, float(i % 4), float(i % 2)) for i in range(400)]
    cells = spark.createDataFrame(rows, "cell long, lat double, lon double")
    found = sphere.nearest_by_place(cells, cells, 3)
    got = {(r.dst_cell, r["rank"]): r.src_cell for r in found.collect()}
    assert got == {(i, k + 1): i % 4 + 4 * k for i in range(400) for k in range(3)}
    assert "Broadcast" not in plan_of(found)


def test_merged_bins_keep_no_state(spark):
    found = lookup_queries.annual_bins_merged(spark, DIR)
    folder = next(f for f in found.inputFiles() if "_batch=" in f).split("/rows/")[0]
    kept = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/progress").select("path").collect()
    assert kept and not any("/state/" in r.path for r in kept)


def test_merged_columns_are_dealt_once_and_kept_as_levels(spark):
    """What the stream keeps are the levels that came, those of June twice and in two batches; bins of all months are written and dealt nowhere."""
    found = lookup_queries.annual_bins_merged(spark, DIR)
    plan = plan_of(found)
    assert plan.count("hashpartitioning(cell") == 1 and "SortMergeJoin" not in plan
    folder = next(f for f in found.inputFiles() if "_batch=" in f).split("/rows/")[0]
    kept, levels = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/_batch=*"), fixture.ocean(spark, DIR)
    assert kept.count() == levels.count() + levels.where("m = 6").count()
    assert kept.where("_month = 6").select("_batch").distinct().count() == 2


def test_bins_are_told_from_the_levels_in_one_aggregate(spark):
    """A bin is a pair's or the bottom's, never both, so one candidate is kept per bin and no arrays of structs are made."""
    plan = plan_of(ocean_queries.profile(spark, DIR))
    assert plan.count(" max_by(") == 0 and plan.count("[max_by(") == 1 and plan.count("partial_max_by(") == 1 and "lambda" not in plan


def test_bins_of_columns_that_cross_levels_again(spark):
    """Against all pairs and the bottom by hand, in columns that go up and down and in flat ones, which are kept whole."""
    rng = random.Random(5)
    data = {c: [rng.choice((18.5, 27.0, 29.0)) + rng.uniform(-1.2, 1.2) for _ in range(rng.randint(1, 6))] for c in range(60)}
    data |= {100 + c: [r := rng.uniform(24, 27), *(rng.uniform(23, 28) for _ in range(4)), r + 0.1] for c in range(20)}
    rows = [(c, i, 10.0 * (i + 1), r) for c, column in data.items() for i, r in enumerate(column)]
    df = spark.createDataFrame(rows, "c int, lev int, z double, rho double")
    got = {(r.c, r.rho_idx): (r.z, r.thick) for r in columns.density_profile(df, ["c"], "lev", "rho", "z", [], GRID).collect()}
    value = lambda i: 19 + i * 0.2 if i < 35 else 26 + (i - 35) * 0.1
    want = {}
    for c, column in data.items():
        lightest, densest = max(i for i, r in enumerate(column) if r == min(column)), min(i for i, r in enumerate(column) if r == max(column))
        levels = [(i, r) for i, r in enumerate(column) if column[-1] - column[0] < 0.2 or lightest <= i <= densest]
        bins = {}
        for (i, a), (_, b) in zip(levels, levels[1:]):
            bins |= {k: 10 * (i + 1) + 10 * (value(k) - a) / (b - a) for k in range(60) if a <= value(k) < b}
        if levels:
            top, at = max((r, i) for i, r in levels)
            k = next((k for k in range(60) if value(k) >= top), None)
            if k is not None:
                assert k not in bins
                bins[k] = 10.0 * (at + 1)
        before = 0.0
        for k in sorted(bins):
            if bins[k] > before and k > 0:
                want[c, k] = bins[k], bins[k] - before
            before = bins[k]
    assert len(want) > 500 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_bins_carry_what_the_query_uses(spark):
    plans = [plan_of(ocean_queries.QUERIES[n](spark, DIR)) for n in ("persistence_pct", "persistent_share")]
    assert all("max_by(struct(z, " in p and "t, t#" not in p and "s, s#" not in p for p in plans)
    plan = plan_of(ocean_queries.isopycnal_slice(spark, DIR))
    assert "t, t#" in plan and "s, s#" not in plan


def test_interpolated_bins_are_neither_sorted_nor_grouped(spark):
    """One sort, that of the levels; a pair leaves out the bins of deeper pairs, in columns that go up and down against all pairs by hand."""
    rng = random.Random(7)
    data = {c: [rng.choice((18.5, 26.0, 29.0)) + rng.uniform(-3, 3) for _ in range(rng.randint(1, 8))] for c in range(80)}
    rows = [(c, i, 10.0 * (i + 1), r) for c, column in data.items() for i, r in enumerate(column)] + [(99, i, 1.0, None) for i in range(3)]
    found = columns.on_density(spark.createDataFrame(rows, "c int, lev int, z double, rho double"), ["c"], "lev", "rho", ["z"], GRID)
    plan = plan_of(found)
    assert plan.count("Sort [") == 1 and "Aggregate(" not in plan
    value = lambda i: 19 + i * 0.2 if i < 35 else 26 + (i - 35) * 0.1
    want, again = {}, 0
    for c, column in data.items():
        for i, (a, b) in enumerate(zip(column, column[1:])):
            made = {(c, k): 10 * (i + 1) + 10 * (value(k) - a) / (b - a) for k in range(60) if a <= value(k) < b}
            again += len(want.keys() & made.keys())
            want |= made
    got = {(r.c, r.rho_idx): r.z for r in found.collect()}
    assert again > 500 and found.count() == len(want) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    whole = plan_of(ocean_queries.interpolate_on_density(spark, DIR))
    assert whole.count("Sort [") == 1 and "max_by" not in whole
