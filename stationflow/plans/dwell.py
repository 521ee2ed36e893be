"""Operator pick time: arrived until triggerGo."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions import stats
from stationflow.functions.times import floor_to
from stationflow.operators.grid import complete_grid, day_start, ticks
from stationflow.operators.pairing import pick_pairs, switch_pairs
from stationflow.operators.quantiles import exact_quantiles
from stationflow.operators.slicing import occupied_seconds, slice_hours
from stationflow.plans.throughput import CELL, station_hour
from stationflow.tables import Tables

BIN_S = 2
X_MAX_S = 180.0
SIGMA_BINS = 2.5
TAPS = 10
MIN_VALUES = 10


def pick_intervals(t: Tables, all_robots: bool = False) -> DataFrame:
    """Pick rows of at least 0 s and less than an hour, by arrival hour."""
    events = t.located() if all_robots else t.delivery()
    s = F.col("seconds")
    return (
        pick_pairs(events, carry=["station"])
        .where((s >= 0) & (s < S.PICK_MAX_S) & F.col("station").isNotNull())
        .select(
            "op_day",
            "robot_id",
            "station",
            floor_to(F.col("start_ts"), "HOUR").alias("hour"),
            F.col("start_ts").alias("arrived_ts"),
            F.col("end_ts").alias("trigger_ts"),
            s.alias("pick_s"),
        )
    )


def _slices(t: Tables) -> DataFrame:
    return slice_hours(pick_intervals(t).drop("hour"), "arrived_ts", "trigger_ts")


def pick_station_hour(t: Tables) -> DataFrame:
    """Median, mean and count of hour-sliced pick seconds; not cut to 24 hours."""
    mean = F.col("mean_s")
    return exact_quantiles(
        _slices(t), CELL, "slice_s", {"median_s": 0.5}, count="slices", mean="mean_s"
    ).withColumn("implied_tph", F.when(mean > 0, S.HOUR_S / (mean + S.FIXED_SWITCH_S)))


def _first_day(cells: DataFrame) -> DataFrame:
    """Cells of the 24 hours from the day's first cell."""
    in_day = F.col("hour") < F.col("day_ts") + F.expr("INTERVAL 24 HOURS")
    return day_start(cells).where(in_day).drop("day_ts")


def weighted_pick(t: Tables) -> DataFrame:
    """Mean of full pick durations weighted by their share of the hour."""
    cells = (
        _slices(t)
        .groupBy(*CELL)
        .agg(
            stats.ratio(F.sum(F.col("frac") * F.col("pick_s")), F.sum("frac")).alias(
                "weighted_pick_s"
            )
        )
    )
    rate = S.HOUR_S / (F.col("weighted_pick_s") + S.FIXED_SWITCH_S)
    kept = _first_day(cells).where(F.col("weighted_pick_s").isNotNull())
    return kept.withColumn("implied_tph", rate)


def scale_anchors(t: Tables) -> DataFrame:
    """p95 of the day's median cells; p5 and p95 of its implied-rate cells."""
    medians = _first_day(pick_station_hour(t)).groupBy("op_day").agg(
        F.percentile("median_s", 0.95).alias("pick_p95_s")
    )
    rates = weighted_pick(t).groupBy("op_day").agg(
        F.percentile("implied_tph", 0.05).alias("rate_p5"),
        F.percentile("implied_tph", 0.95).alias("rate_p95"),
    )
    return medians.join(rates, "op_day", "left")


def _shown_values(picks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Different picks and their number ``n`` up to ``x_max`` = min(p99, 180 s).

    The limit and the kept values both start from these counts, so the pairing is
    done once.
    """
    counts = picks.groupBy(*by, "station", "pick_s").agg(F.count("*").alias("n"))
    top = exact_quantiles(counts, by, "pick_s", {"p99": 0.99}, weight="n").select(
        *by, F.least("p99", F.lit(X_MAX_S)).alias("x_max")
    )
    if by:
        joined = counts.join(top, list(by))
    else:
        joined = counts.withColumn("x_max", top.select("x_max").scalar())
    return joined.where(F.col("pick_s").between(0, F.col("x_max")))


def pick_density(picks: DataFrame, by: Sequence[str] = ("op_day",)) -> DataFrame:
    """Smoothed density of ``pick_s`` per station in 2-second bins.

    Every histogram bin hands its density to its 21 neighbours by a normal
    weight; weight that falls outside the bins is lost.
    """
    group = [*by, "station"]
    bins = F.ceil(F.col("x_max") / BIN_S).cast("int")
    per_bin = (
        _shown_values(picks, by)
        .withColumn("bins", bins)
        .where(F.col("bins") > 0)
        .withColumn(
            "bin", F.least(F.floor(F.col("pick_s") / BIN_S).cast("int"), F.col("bins") - 1)
        )
        .groupBy(*group, "bins", "bin")
        .agg(F.sum("n").alias("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
        .where(F.col("total") >= MIN_VALUES)
        .withColumn("density", F.col("n") / (F.col("total") * BIN_S))
    )
    mass = sum(math.exp(-0.5 * (k / SIGMA_BINS) ** 2) for k in range(-TAPS, TAPS + 1))
    shift = F.col("shift") / SIGMA_BINS
    spread = per_bin.withColumn(
        "shift", F.explode(F.sequence(F.lit(-TAPS), F.lit(TAPS)))
    ).select(
        *group,
        (F.col("bin") + F.col("shift")).alias("bin"),
        "bins",
        F.lit(0.0).alias("density"),
        (F.col("density") * F.exp(-0.5 * shift * shift) / mass).alias("smooth"),
    )
    own = per_bin.select(*group, "bin", "bins", "density", F.lit(0.0).alias("smooth"))
    empty = (
        per_bin.select(*group, "bins")
        .distinct()
        .select(
            *group,
            F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"),
            "bins",
            F.lit(0.0).alias("density"),
            F.lit(0.0).alias("smooth"),
        )
    )
    return (
        spread.unionByName(own)
        .unionByName(empty)
        .where((F.col("bin") >= 0) & (F.col("bin") < F.col("bins")))
        .groupBy(*group, "bin")
        .agg(F.sum("density").alias("density"), F.sum("smooth").alias("smooth_density"))
        .withColumn("center_s", F.col("bin") * float(BIN_S) + BIN_S / 2)
    )


def pick_averages(picks: DataFrame, by: Sequence[str] = ("op_day",)) -> DataFrame:
    """Mean and median pick within ``x_max`` of stations with at least 10 values."""
    return exact_quantiles(
        _shown_values(picks, by), [*by, "station"], "pick_s", {"median_s": 0.5},
        count="picks", mean="mean_s", weight="n",
    ).where(F.col("picks") >= MIN_VALUES)


def occupancy(t: Tables) -> DataFrame:
    """Pick and switch seconds per station and hour, all robots, over 24 hours."""
    picks = pick_intervals(t, all_robots=True)
    pick_cells = occupied_seconds(
        picks.select(
            "op_day", "station", F.col("arrived_ts").alias("start_ts"),
            F.col("trigger_ts").alias("end_ts"),
        ),
        ["op_day", "station"],
    ).withColumnRenamed("occupied_s", "pick_s")
    s = F.col("seconds")
    switches = switch_pairs(t.located()).where((s >= 0) & (s < S.SWITCH_MAX_S))
    switch_cells = occupied_seconds(switches, ["op_day", "station"]).withColumnRenamed(
        "occupied_s", "switch_s"
    )
    days = picks.groupBy("op_day").agg(floor_to(F.min("hour"), "DAY").alias("day_ts"))
    grid = ticks(t.day_stations().join(days, "op_day"), "HOUR", 24, "hour")
    full = complete_grid(grid, pick_cells, CELL, {"pick_s": 0.0})
    full = complete_grid(full, switch_cells, CELL, {"switch_s": 0.0})
    both = F.least(F.col("pick_s") + F.col("switch_s"), F.lit(S.HOUR_S))
    return full.select(
        *CELL,
        "pick_s",
        "switch_s",
        (F.col("pick_s") / S.HOUR_S * 100).alias("pick_pct"),
        (both / S.HOUR_S * 100).alias("station_pct"),
    )


def occupancy_summary(t: Tables) -> DataFrame:
    return (
        occupancy(t)
        .groupBy("op_day")
        .agg(
            F.avg("pick_pct").alias("mean_pick_pct"),
            F.median("pick_pct").alias("median_pick_pct"),
            F.avg("station_pct").alias("mean_station_pct"),
            F.median("station_pct").alias("median_station_pct"),
        )
    )


def pick_vs_throughput(t: Tables) -> DataFrame:
    """Mean pick against completions per cell, outliers by Tukey's fence flagged.

    With fewer than four inliers all points of the day are kept.
    """
    picks = _first_day(pick_station_hour(t)).select(*CELL, F.col("mean_s").alias("pick_s"))
    pairs = station_hour(t).join(picks, CELL).where(
        (F.col("pick_s") > 0) & (F.col("completions") > 0)
    )
    quarters = F.array(F.lit(0.25), F.lit(0.75))
    fences = pairs.groupBy("op_day").agg(
        F.percentile("pick_s", quarters).alias("_pick_s"),
        F.percentile("completions", quarters).alias("_completions"),
    )

    def inside(name: str):
        q = F.col(f"_{name}")
        reach = (q[1] - q[0]) * 1.5
        return F.col(name).between(q[0] - reach, q[1] + reach)

    marked = pairs.join(fences, "op_day").withColumn(
        "inlier", inside("pick_s") & inside("completions")
    ).drop("_pick_s", "_completions")
    kept = marked.groupBy("op_day").agg(F.sum(F.col("inlier").cast("int")).alias("_kept"))
    return (
        marked.join(kept, "op_day")
        .withColumn("used", F.col("inlier") | (F.col("_kept") < 4))
        .drop("_kept")
        .withColumn("ceiling_tph", S.HOUR_S / (F.col("pick_s") + S.FIXED_SWITCH_S))
    )


def pick_vs_throughput_fit(t: Tables) -> DataFrame:
    """Least-squares line through the kept points of each day."""
    x = F.when(F.col("used"), F.col("pick_s"))
    y = F.when(F.col("used"), F.col("completions").cast("double"))
    return (
        pick_vs_throughput(t)
        .groupBy("op_day")
        .agg(
            stats.slope(x, y).alias("slope"),
            stats.intercept(x, y).alias("intercept"),
            stats.r_squared(x, y).alias("r2"),
            F.count(x).alias("used"),
            F.sum((~F.col("used")).cast("bigint")).alias("removed"),
        )
    )
