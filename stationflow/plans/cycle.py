"""Task cycle time and its stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions import stats
from stationflow.functions.text import is_labor
from stationflow.functions.times import floor_to
from stationflow.operators.quantiles import exact_quantiles
from stationflow.tables import Tables

CAP_MIN = 30
BINS = 60
MINUTE_STEP = 1.0 / 60.0


def cycle_rows(t: Tables) -> DataFrame:
    """Tasks of [0, 7200) s with ``cycle_min`` and the hour of completion."""
    total = F.col("total_s")
    return t.lifecycle.where((total >= 0) & (total < S.CYCLE_MAX_S)).select(
        "op_day",
        "task_code",
        "dest_loc",
        "total_s",
        (total / 60.0).alias("cycle_min"),
        floor_to(F.col("completed_ts"), "HOUR").alias("hour"),
    )


def cycle_histogram(t: Tables) -> DataFrame:
    """Half-minute bins up to 30 minutes; the last bin holds all longer tasks."""
    bin_of = F.least(F.floor(F.col("cycle_min") * 2).cast("int"), F.lit(BINS - 1))
    tasks = cycle_rows(t).groupBy("op_day", bin_of.alias("bin")).agg(F.count("*").alias("tasks"))
    grid = tasks.select("op_day").distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1)))
    )
    return (
        grid.join(tasks, ["op_day", "bin"], "left")
        .fillna({"tasks": 0})
        .withColumn("from_min", F.col("bin") * 0.5)
    )


def cycle_summary(t: Tables) -> DataFrame:
    rows = cycle_rows(t)
    shares = rows.groupBy("op_day").agg(
        (F.avg((F.col("cycle_min") > CAP_MIN).cast("double")) * 100).alias("pct_beyond_cap")
    )
    return exact_quantiles(
        rows, ["op_day"], "cycle_min", {"median_min": 0.5, "p90_min": 0.9, "p99_min": 0.99},
        MINUTE_STEP, count="tasks",
    ).join(shares, "op_day")


def cycle_by_hour(t: Tables) -> DataFrame:
    """Median and p90 per hour of completion; the first highest median is marked."""
    rows = cycle_rows(t).where(F.col("hour").isNotNull())
    by_height = Window.partitionBy("op_day").orderBy(F.desc("median_min"), "hour")
    return exact_quantiles(
        rows, ["op_day", "hour"], "cycle_min", {"median_min": 0.5, "p90_min": 0.9}, MINUTE_STEP
    ).withColumn("is_peak", F.row_number().over(by_height) == 1)


def labor_completions(t: Tables) -> DataFrame:
    """``complete`` callbacks at labor stations, with their hour."""
    done = (F.col("action") == S.COMPLETE) & is_labor(F.col("location_type"))
    return t.callback.where(done & F.col("ts").isNotNull()).withColumn(
        "hour", floor_to(F.col("ts"), "HOUR")
    )


def demand_vs_cycle(t: Tables) -> DataFrame:
    """Hours that have both completions and cycle times."""
    demand = labor_completions(t).groupBy("op_day", "hour").agg(F.count("*").alias("demand"))
    median = cycle_by_hour(t).select("op_day", "hour", F.col("median_min").alias("cycle_min"))
    return demand.join(median, ["op_day", "hour"])


def average_rank(value: str, keys: list[str]):
    """1-based rank per ``keys``; ties share their mean rank."""
    ranked = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    return ranked + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def demand_vs_cycle_fit(t: Tables) -> DataFrame:
    """Pearson r, Spearman rho and the linear trend over the day's hours."""
    x, y = F.col("demand").cast("double"), F.col("cycle_min")
    ranked = demand_vs_cycle(t).withColumns(
        {
            "rank_x": average_rank("demand", ["op_day"]),
            "rank_y": average_rank("cycle_min", ["op_day"]),
        }
    )
    return ranked.groupBy("op_day").agg(
        F.count("*").alias("hours"),
        stats.corr(x, y).alias("pearson_r"),
        stats.corr(F.col("rank_x"), F.col("rank_y")).alias("spearman_rho"),
        stats.slope(x, y).alias("slope"),
        stats.intercept(x, y).alias("intercept"),
    )


def _stage_seconds(stages: DataFrame) -> DataFrame:
    s = F.col("seconds")
    return stages.where((s >= 0) & (s < S.STAGE_MAX_S))


def _day_stages(t: Tables) -> DataFrame:
    """Stages with any value that day."""
    used = t.stage.where(F.col("seconds").isNotNull())
    return used.select("op_day", "stage", "stage_label", "stage_ord").distinct()


def stage_shares(t: Tables) -> DataFrame:
    """Median of each stage on its own, its share of their sum, and the total median."""
    medians = exact_quantiles(
        _stage_seconds(t.stage), ["op_day", "stage"], "seconds", {"median_s": 0.5}
    )
    totals = exact_quantiles(cycle_rows(t), ["op_day"], "total_s", {"total_median_s": 0.5})
    day = Window.partitionBy("op_day")
    return (
        _day_stages(t)
        .join(medians, ["op_day", "stage"], "left")
        .fillna({"median_s": 0.0})
        .withColumn("share", stats.ratio(F.col("median_s"), F.sum("median_s").over(day)))
        .join(totals, "op_day", "left")
    )


def stage_by_station(t: Tables) -> DataFrame:
    """Stage median per destination station and the stack base below it.

    Only tasks with a valid total count; a stage without values has height 0.
    """
    total = F.col("total_s")
    valid = t.stage.where(
        (total >= 0) & (total < S.CYCLE_MAX_S) & is_labor(F.col("dest_loc"))
    ).withColumn("station", F.col("dest_loc"))
    medians = exact_quantiles(
        _stage_seconds(valid), ["op_day", "station", "stage"], "seconds", {"median_s": 0.5}
    )
    below = (
        Window.partitionBy("op_day", "station")
        .orderBy("stage_ord")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    height = F.coalesce("median_s", F.lit(0.0))
    return (
        t.day_stations()
        .join(_day_stages(t), "op_day")
        .join(medians, ["op_day", "station", "stage"], "left")
        .withColumn("height_s", height)
        .withColumn("base_s", F.coalesce(F.sum("height_s").over(below), F.lit(0.0)))
    )


def cycle_describe(t: Tables) -> DataFrame:
    rows = cycle_rows(t)
    spread = rows.groupBy("op_day").agg(F.stddev_samp("cycle_min").alias("std_min"))
    named = {
        "min_min": 0.0, "p50_min": 0.5, "p75_min": 0.75, "p90_min": 0.9, "p95_min": 0.95,
        "p99_min": 0.99, "max_min": 1.0,
    }
    return exact_quantiles(
        rows, ["op_day"], "cycle_min", named, MINUTE_STEP, count="tasks", mean="mean_min"
    ).join(spread, "op_day")
