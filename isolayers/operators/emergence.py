"""Time of emergence of signals over noise, noise estimates, boxes and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_of_emergence(df: DataFrame, keys: list[str], time: str, signal: Column, noise: Column, mult: float = 1.0, strict: bool = False, out: str = "toe") -> DataFrame:
    """Index after the last step that has not emerged (|signal| >= mult * noise); N steps from 0.

    A missing signal or noise has not emerged. Never emerged gives N; always emerged N as well, or 0 if strict. A plain aggregate: no
    order of the rows is needed. What lacks less than a billionth of the noise is rounding and counts as equal, whatever the unit, so exact ties
    don't depend on the order of sums.
    """
    on = F.coalesce(F.abs(signal) >= mult * noise * (1 - 1e-9), F.lit(False))
    rows = df.groupBy(*keys).agg(F.max(F.when(~on, F.col(time))).alias("_off"), F.count(F.lit(1)).alias("_n"), F.min(time).alias("_t0"))
    always = F.lit(0) if strict else F.col("_n")
    return rows.select(*keys, F.coalesce(F.col("_off") - F.col("_t0") + 1, always).cast("int").alias(out))


def time_of_emergence_2(df: DataFrame, keys: list[str], time: str, signal: Column, noise1: Column, noise2: Column, change: int, mult: float = 1.0) -> DataFrame:
    """One noise before the time `change`, another from there on."""
    return time_of_emergence(df, keys, time, signal, F.when(F.col(time) < change, noise1).otherwise(noise2), mult)


def last_years_disagree(df: DataFrame, keys: list[str], time: str, signal: str, noise: str, years: int = 5, times: float = 2.0) -> DataFrame:
    """Keys whose mean signal of the last years, against the expected sign (column expected: 1 or -1), exceeds times * noise."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).desc()))
    ends = df.withColumn("_r", rank).where(F.col("_r") <= years).groupBy(*keys).agg(F.avg(signal).alias("_s"), F.max(noise).alias("_n"), F.max("expected").alias("_e"))
    return ends.where((F.col("_s") * F.col("_e") < 0) & (F.abs("_s") > times * F.col("_n"))).select(*keys)


def box_average(df: DataFrame, boxes: DataFrame, on: list[str], keys: list[str], lat: str, rho: str, value: str, inclusive: bool = False) -> DataFrame:
    """Mean over density, then over latitude, of the points in each box (latmin, latmax, rhomin, rhomax, with the columns `on`).

    Both last points of a box are left out unless inclusive. Boxes are a small table, joined by `on`.
    """
    inside = F.col(lat).between(F.col("latmin"), F.col("latmax")) & F.col(rho).between(F.col("rhomin"), F.col("rhomax"))
    rows = df.join(boxes, on).where(inside)
    if not inclusive:
        w = Window.partitionBy(*keys)
        rows = rows.withColumn("_lat", F.max(lat).over(w)).withColumn("_rho", F.max(rho).over(w))
        rows = rows.where((F.col(lat) < F.col("_lat")) & (F.col(rho) < F.col("_rho")))
    return rows.groupBy(*keys, lat).agg(F.avg(value).alias("_v")).groupBy(*keys).agg(F.avg("_v").alias(value))


def noise_average_std(df: DataFrame, boxes: DataFrame, on: list[str], keys: list[str], time: str, lat: str, rho: str, value: str, inclusive: bool = False) -> DataFrame:
    """Standard deviation in time at each point, then the box average."""
    point = list(dict.fromkeys([*on, *(k for k in keys if k not in boxes.columns), lat, rho]))
    return box_average(df.groupBy(*point).agg(F.stddev_pop(value).alias(value)), boxes, on, keys, lat, rho, value, inclusive)


def noise_std_average(df: DataFrame, boxes: DataFrame, on: list[str], keys: list[str], time: str, lat: str, rho: str, value: str, inclusive: bool = False) -> DataFrame:
    """Box average at each time, then its standard deviation."""
    return box_average(df, boxes, on, [*keys, time], lat, rho, value, inclusive).groupBy(*keys).agg(F.stddev_pop(value).alias(value))


def signal_over(df: DataFrame, control: DataFrame, keys: list[str], value: str, out: str = "signal") -> DataFrame:
    """value minus the control's, joined by keys (with the time for a yearly control, without it for a constant one)."""
    c = control.select(*keys, F.col(value).alias("_c"))
    return df.join(c, keys).withColumn(out, F.col(value) - F.col("_c")).drop("_c")


def median_of_medians(df: DataFrame, model: str, keys: list[str], value: str) -> DataFrame:
    """Rounded median over models of the models' medians, and the median over all runs."""
    each = df.groupBy(*keys, model).agg(F.median(value).alias("_m")).groupBy(*keys).agg(F.rint(F.median("_m")).alias("median_of_medians"))
    return each.join(df.groupBy(*keys).agg(F.rint(F.median(value)).alias("median_of_all")), keys)


def histogram(df: DataFrame, keys: list[str], value: str, low: float, width: float, bins: int) -> DataFrame:
    """Counts per bin [edge, next edge), the last bin closed; values outside are left out."""
    at = F.floor((F.col(value) - low) / width).cast("int")
    at = F.when(F.col(value) == low + width * bins, bins - 1).when((at >= 0) & (at < bins), at)
    return df.withColumn("bin", at).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = F.percentile(value, [0.25, 0.5, 0.75])
    return df.groupBy(*keys).agg(q.alias("_q")).select(*keys, *(F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))))


def noise_summary(df: DataFrame, keys: list[str], value: str, most: float = 10.0) -> DataFrame:
    """Mean and spread over runs; values over `most` are errors and count as missing."""
    v = F.when(F.col(value) <= most, F.col(value))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def agreement_detection(df: DataFrame, keys: list[str], time: str, agree: str, least: float = 0.6) -> DataFrame:
    """First time from which the agreement stays above a level: the time of emergence of the agreement itself."""
    return time_of_emergence(df, keys, time, F.col(agree), F.lit(least))


def emerged_only(df: DataFrame, toe: str, steps: int | Column) -> DataFrame:
    """Times of emergence that equal the number of steps (never) become null."""
    return df.withColumn(toe, F.when(F.col(toe) != steps, F.col(toe)))


def outside_bowl(df: DataFrame, bowl: DataFrame, keys: list[str], rho: str, limit: str, toe: str, steps: Column, values: Column) -> DataFrame:
    """Times of emergence as they are drawn: missing where never emerged (toe = steps), where the field lacks a value (values < steps), and lighter than the bowl's
    density `limit` of the keys; all are missing where the bowl is."""
    rows = df.join(bowl.select(*keys, limit), keys, "left")
    return rows.withColumn(toe, F.when((F.col(toe) != steps) & (values >= steps) & (F.col(rho) >= F.col(limit)), F.col(toe))).drop(limit)


def concatenated(first: DataFrame, second: DataFrame, ids: list[str], year: str, shift: int = 0) -> DataFrame:
    """Runs that both have, one after the other; the second's years are moved by `shift`."""
    a = first.join(second.select(*ids).distinct(), ids, "left_semi")
    b = second.join(first.select(*ids).distinct(), ids, "left_semi").withColumn(year, F.col(year) + shift)
    return a.unionByName(b)


def signal_of_scenarios(
    hist: DataFrame, natural: DataFrame, future: DataFrame, control: DataFrame, ids: list[str], point: list[str], year: str, value: str, out: str = "signal"
) -> DataFrame:
    """(ids, point, year, signal): historical runs minus the natural ensemble's mean of the same year, then future runs minus the control's mean in time.

    ids name a run, point where it is. Only runs that have both parts count.
    """
    base = natural.groupBy(*point, year).agg(F.avg(value).alias("_c"))
    level = control.groupBy(*point).agg(F.avg(value).alias("_c"))
    first = hist.join(future.select(*ids).distinct(), ids, "left_semi").join(base, [*point, year])
    second = future.join(hist.select(*ids).distinct(), ids, "left_semi").join(level, point)
    part = lambda df: df.select(*ids, *point, year, (F.col(value) - F.col("_c")).alias(out))
    return part(first).unionByName(part(second))


def scenario_block(
    df: DataFrame, ids: list[str], point: list[str], year: str, value: str, change: int, natural: Column, control: Column, out: str = "signal"
) -> DataFrame:
    """signal_of_scenarios and its noise from one table: (ids, point, year, signal, noise1, noise2), the history before the year `change`.

    natural tells the rows of the natural runs (those of the history count), control those of the control. noise1 and noise2 are the largest standard
    deviations in time of a run at the point, before `change` and from there on, over all runs. df has one row per (ids, point, year). The rows
    are dealt once, by point, where all means and deviations are windows; only which runs have both parts comes from a second, narrow aggregate.
    """
    past = F.col(year) < change
    year_mean, point_mean, own, whole = (Window.partitionBy(*k) for k in ([*point, year], point, [*point, *ids], point))
    base, level = F.when(past & natural, F.col(value)), F.when(control, F.col(value))
    std = lambda c: F.stddev_pop(F.when(c, F.col(value))).over(own)
    rows = df.repartition(*point).withColumns({"_s1": std(past), "_s2": std(~past)})
    rows = rows.withColumns({
        "_b": F.avg(base).over(year_mean), "_bn": F.count(F.when(past & natural, 1)).over(year_mean),
        "_l": F.avg(level).over(point_mean), "_ln": F.count(F.when(control, 1)).over(point_mean),
        "noise1": F.max("_s1").over(whole), "noise2": F.max("_s2").over(whole),
    })
    rows = rows.where(F.when(past, F.col("_bn")).otherwise(F.col("_ln")) > 0)
    both = df.groupBy(*ids).agg(F.min(year).alias("_from"), F.max(year).alias("_to")).where((F.col("_from") < change) & (F.col("_to") >= change))
    signal = F.col(value) - F.when(past, F.col("_b")).otherwise(F.col("_l"))
    return rows.join(both, ids, "left_semi").select(*ids, *point, year, signal.alias(out), "noise1", "noise2")


def signal_and_noise(
    df: DataFrame, keys: list[str], member: list[str], value: str, control: Column | None = None, noisy: Column | None = None,
    out: str = "signal", noise: str = "noise"
) -> DataFrame:
    """df with the signal (value minus its mean over the control's rows of the keys) and the noise (largest standard deviation of a member over its noisy rows).

    Without control all rows are the control; noisy are the control's rows unless given. Keys without a row of the control are
    left out. Rows are dealt once, by the keys, and neither the control nor the noise is joined.
    """
    control = F.lit(True) if control is None else control
    noisy = control if noisy is None else noisy
    own, whole = Window.partitionBy(*keys, *member), Window.partitionBy(*keys)
    rows = df.repartition(*keys).withColumn("_s", F.stddev_pop(F.when(noisy, F.col(value))).over(own))
    rows = rows.withColumns({"_c": F.avg(F.when(control, F.col(value))).over(whole), "_n": F.count(F.when(control, 1)).over(whole), noise: F.max("_s").over(whole)})
    rows = rows.where("_n > 0").withColumn(out, F.col(value) - F.col("_c"))
    return rows.drop("_s", "_c", "_n")


def average_of_emergence(toe: DataFrame, boxes: DataFrame, on: list[str], keys: list[str], lat: str, rho: str, value: str = "toe", inclusive: bool = False) -> DataFrame:
    """Box average of the times of emergence of points, rounded to the nearest even."""
    found = box_average(toe, boxes, on, keys, lat, rho, value, inclusive)
    return found.withColumn(value, F.rint(value).cast("int"))


def paired_with_noise(toe: DataFrame, noise: DataFrame, keys: list[str], scenario: str) -> DataFrame:
    """Median time of emergence and largest noise per key and scenario, for those that have both."""
    t = toe.groupBy(*keys, scenario).agg(F.median("toe").alias("toe"))
    n = noise.groupBy(*keys, scenario).agg(F.max("noise").alias("noise"))
    return t.join(n, [*keys, scenario])


def box_series(df: DataFrame, control: DataFrame, boxes: DataFrame, on: list[str], keys: list[str], time: str, lat: str, rho: str, value: str, inclusive: bool = False) -> DataFrame:
    """Box average at each time minus the control's mean box average."""
    run = box_average(df, boxes, on, [*keys, time], lat, rho, value, inclusive)
    base = box_average(control, boxes, on, [*keys, time], lat, rho, value, inclusive).groupBy(*keys).agg(F.avg(value).alias("_c"))
    return run.join(base, keys).select(*keys, time, (F.col(value) - F.col("_c")).alias(value))
