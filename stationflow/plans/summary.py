"""Day-over-day summary: one row per day and metric."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions import stats
from stationflow.functions.times import floor_to
from stationflow.operators.pairing import pick_pairs, switch_pairs
from stationflow.operators.quantiles import exact_quantiles
from stationflow.operators.stations import completions, with_station
from stationflow.plans.cycle import MINUTE_STEP, cycle_rows, labor_completions
from stationflow.plans.dwell import _first_day, pick_intervals
from stationflow.plans.throughput import CELL
from stationflow.session import settle
from stationflow.tables import Tables

OVERLAY_MAX_S = 1800.0
OVERLAY_MIN_ROWS = 10
MIN_SCALE_PCT = 5.0
EMPTY_SCALE_PCT = 20.0
MODERATE_TAIL, SEVERE_TAIL = 1.5, 2.0
METRICS = {
    "total_tasks": 1,
    "median_cycle_min": -1,
    "p90_cycle_min": -1,
    "mean_pick_s": -1,
    "median_switch_s": -1,
}


def _two_days(rows: DataFrame) -> DataFrame:
    """Per-day rows (few, so they may meet in one window), or nothing below two days."""
    return rows.withColumn("_days", F.count("*").over(Window.partitionBy())).where("_days >= 2").drop("_days")


def _picks(events: DataFrame, carry: list[str]) -> DataFrame:
    s = F.col("seconds")
    return pick_pairs(events, carry).where((s >= 0) & (s < S.PICK_MAX_S))


def daily_stats(t: Tables) -> DataFrame:
    """Tasks, cycle, pick and switch figures per day.

    Picks and switches take all robots and unmapped locations too.
    """
    done = (F.col("event_type") == S.TRIGGER_GO) & F.col("station").isNotNull()
    tasks = settle(t.located().groupBy("op_day").agg(F.count_if(done).alias("total_tasks")))
    days = reduce(
        DataFrame.unionByName, [df.select("op_day") for df in (tasks, t.lifecycle, t.callback) if df is not None]
    ).distinct()
    cycle = exact_quantiles(
        cycle_rows(t), ["op_day"], "cycle_min",
        {"median_cycle_min": 0.5, "p90_cycle_min": 0.9}, MINUTE_STEP,
    )
    pick = _picks(t.events(), []).groupBy("op_day").agg(F.avg("seconds").alias("mean_pick_s"))
    gap = F.col("seconds")
    switch = exact_quantiles(
        switch_pairs(t.events(), "location_code").where((gap >= 0) & (gap < S.SWITCH_MAX_S)),
        ["op_day"], "seconds", {"median_switch_s": 0.5},
    )
    return reduce(lambda a, b: a.join(b, "op_day", "left"), [days, tasks, cycle, pick, switch])


def pick_by_station(t: Tables) -> DataFrame:
    picks = _picks(t.located(), ["station"]).where(F.col("station").isNotNull())
    return picks.groupBy("op_day", "station").agg(F.avg("seconds").alias("mean_pick_s"))


def implied_by_station(t: Tables) -> DataFrame:
    """Mean over trigger hours of picks against the implied hourly rate, in %."""
    picks = _picks(t.located(), ["station"]).where(F.col("station").isNotNull())
    hourly = picks.groupBy("op_day", "station", floor_to(F.col("end_ts"), "HOUR").alias("hour")).agg(
        F.count("*").alias("n"), F.avg("seconds").alias("mean_s")
    )
    pct = F.col("n") * (F.col("mean_s") + S.FIXED_SWITCH_S) / S.HOUR_S * 100
    return hourly.groupBy("op_day", "station").agg(F.avg(pct).alias("implied_pct"))


def implied_by_day(t: Tables) -> DataFrame:
    return implied_by_station(t).groupBy("op_day").agg(F.avg("implied_pct").alias("implied_pct"))


def headline_trend(t: Tables) -> DataFrame:
    """Tasks and median cycle per day; empty unless there are two days."""
    rows = daily_stats(t).select("op_day", "total_tasks", "median_cycle_min")
    return _two_days(rows)


def day_changes(t: Tables) -> DataFrame:
    """% change from the day before per metric; ``improvement_pct`` > 0 is better.

    A metric without any change is left out. ``scale_pct`` spans all changes.
    """
    flat = daily_stats(t).select(
        "op_day", *[F.col(m).cast("double").alias(m) for m in METRICS]
    )
    long = flat.unpivot("op_day", list(METRICS), "metric", "value")
    by_day = Window.partitionBy("metric").orderBy("op_day")
    before = F.col("previous")
    change = stats.ratio(F.col("value") - before, F.abs(before)) * 100
    sign = F.when(F.col("metric") == "total_tasks", 1).otherwise(-1)
    moved = (
        long.withColumns(
            {
                "previous": F.lag("value").over(by_day),
                "previous_day": F.lag("op_day").over(by_day),
            }
        )
        .where(F.col("previous_day").isNotNull())
        .withColumn("change_pct", change)
        .withColumn("improvement_pct", F.col("change_pct") * sign)
        .withColumn("_any", F.max("change_pct").over(Window.partitionBy("metric")))
        .where(F.col("_any").isNotNull())
    )
    top = F.max(F.abs("change_pct")).over(Window.partitionBy())
    scale = F.when(top.isNull(), EMPTY_SCALE_PCT).otherwise(F.greatest(top, F.lit(MIN_SCALE_PCT)))
    return moved.select(
        "metric", "previous_day", "op_day", "change_pct", "improvement_pct",
        scale.alias("scale_pct"),
    )


def tail_severity(t: Tables) -> DataFrame:
    """p90 over median cycle time, with its class."""
    ratio = stats.ratio(F.col("p90_cycle_min"), F.col("median_cycle_min"))
    level = (
        F.when(F.col("tail_ratio") >= SEVERE_TAIL, "severe")
        .when(F.col("tail_ratio") >= MODERATE_TAIL, "moderate")
        .when(F.col("tail_ratio").isNotNull(), "normal")
    )
    return (
        daily_stats(t)
        .select("op_day", ratio.alias("tail_ratio"))
        .withColumn("level", level)
    )


def hourly_consistency(t: Tables) -> DataFrame:
    """Variation and peak of the hourly completions; NULL below two hours."""
    hourly = labor_completions(t).groupBy("op_day", "hour").agg(F.count("*").alias("n"))
    mean, two = F.avg("n"), F.count("*") >= 2
    return hourly.groupBy("op_day").agg(
        F.count("*").alias("hours"),
        F.when(two, F.stddev_samp("n") / mean).alias("cv"),
        F.when(two, F.max("n") / mean).alias("peak_to_mean"),
    )


def _overlay(t: Tables) -> DataFrame:
    total = F.col("total_s")
    return t.lifecycle.where((total >= 0) & (total < OVERLAY_MAX_S)).select(
        "op_day", (total / 60.0).alias("cycle_min")
    )


def overlay_stats(t: Tables) -> DataFrame:
    """Quartiles and mean of tasks under 30 minutes, on days with at least 10."""
    named = {"p25_min": 0.25, "p50_min": 0.5, "p75_min": 0.75}
    days = exact_quantiles(
        _overlay(t), ["op_day"], "cycle_min", named, MINUTE_STEP, count="tasks", mean="mean_min"
    ).where(F.col("tasks") >= OVERLAY_MIN_ROWS)
    return _two_days(days)


def overlay_rows(t: Tables) -> DataFrame:
    """The rows behind :func:`overlay_stats`."""
    sizes = _overlay(t).groupBy("op_day").agg(F.count("*").alias("_n"))
    days = sizes.where(F.col("_n") >= OVERLAY_MIN_ROWS)
    return _overlay(t).join(_two_days(days), "op_day", "left_semi")


def cycle_percentiles(t: Tables) -> DataFrame:
    named = {
        "p25_min": 0.25, "p50_min": 0.5, "p75_min": 0.75, "p90_min": 0.9, "p95_min": 0.95,
        "p99_min": 0.99,
    }
    return exact_quantiles(
        cycle_rows(t), ["op_day"], "cycle_min", named, MINUTE_STEP, count="tasks", mean="mean_min"
    )


def pick_fit_by_day(t: Tables) -> DataFrame:
    """Hourly completions against mean pick per station and hour, fitted per day."""
    picks = _first_day(
        pick_intervals(t).groupBy(*CELL).agg(F.avg("pick_s").alias("mean_pick_s"))
    )
    done = labor_completions(t).drop("location_code").withColumnRenamed(
        "location_type", "location_code"
    )
    named = with_station(done, t.stations).withColumn(
        "station", F.coalesce("station", "location_code")
    )
    tasks = named.groupBy(*CELL).agg(F.count("*").cast("double").alias("tasks"))
    x, y = F.col("mean_pick_s"), F.col("tasks")
    points = picks.join(tasks, CELL).where((x > 0) & (y > 0))
    fit = points.groupBy("op_day").agg(
        F.count("*").alias("n"),
        stats.r_squared(x, y).alias("r2"),
        stats.slope(x, y).alias("slope"),
    )
    enough = F.col("n") >= 3
    return (
        picks.select("op_day")
        .distinct()
        .join(fit, "op_day", "left")
        .select(
            "op_day",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.when(enough, F.col("r2")).alias("r2"),
            F.when(enough, F.col("slope")).alias("slope"),
        )
    )
