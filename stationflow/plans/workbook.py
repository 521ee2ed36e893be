"""Tables that back the exported workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.stats import ratio
from stationflow.functions.times import floor_to, hour_label
from stationflow.operators.grid import complete_grid, ticks
from stationflow.plans.dwell import pick_intervals
from stationflow.plans.switch import switch_intervals
from stationflow.plans.throughput import CELL
from stationflow.tables import Tables

LABELLED = ["op_day", "station", "hour_label"]


def completion_events(t: Tables) -> DataFrame:
    return t.completions().select(
        "op_day", "ts", hour_label(F.col("ts")).alias("hour_label"), "station"
    )


def throughput_matrix(t: Tables) -> DataFrame:
    """Completions per hour and station with row, column and grand totals."""
    cells = completion_events(t).groupBy(*LABELLED).agg(F.count("*").alias("n"))
    row, column = ["op_day", "hour_label"], ["op_day", "station"]
    sets = [LABELLED, row, column, ["op_day"]]
    keys = [[F.col(c) for c in one] for one in sets]
    total = F.lit("TOTAL")
    return (
        cells.groupingSets(keys, *[F.col(c) for c in LABELLED])
        .agg(
            F.sum("n").alias("completions"),
            F.grouping("hour_label").alias("_all_hours"),
            F.grouping("station").alias("_all_stations"),
        )
        .select(
            "op_day",
            F.when(F.col("_all_hours") == 1, total).otherwise(F.col("hour_label")).alias("hour_label"),
            F.when(F.col("_all_stations") == 1, total).otherwise(F.col("station")).alias("station"),
            "completions",
        )
    )


def pick_events(t: Tables) -> DataFrame:
    """Picks of all robots."""
    return pick_intervals(t, all_robots=True).withColumn("hour_label", hour_label(F.col("hour")))


def switch_events(t: Tables) -> DataFrame:
    return switch_intervals(t).withColumn("hour_label", hour_label(F.col("hour")))


def _chain_sums(t: Tables) -> DataFrame:
    """Mean pick, mean switch and completions per station and hour of day, from one grouping."""
    t.share_events()
    rows = (
        pick_events(t).select(*LABELLED, "pick_s")
        .unionByName(switch_events(t).select(*LABELLED, "switch_s"), allowMissingColumns=True)
        .unionByName(completion_events(t).select(*LABELLED, F.lit(1).alias("done")), allowMissingColumns=True)
    )
    return rows.groupBy(*LABELLED).agg(
        F.avg("pick_s").alias("avg_pick_s"), F.avg("switch_s").alias("avg_switch_s"), F.count("done").alias("completions")
    )


def utilisation_chain(t: Tables) -> DataFrame:
    """Implied rates and utilisation per station and hour of day.

    Completions take the delivery robots only, picks and switches take all.
    Undefined figures are NULL.
    """
    sums = t.kept("chain_sums", lambda: _chain_sums(t))
    days = sums.where("avg_pick_s IS NOT NULL").select("op_day").distinct()
    label = F.concat(F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":00"))
    grid = (
        t.day_stations()
        .join(days, "op_day", "left_semi")
        .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
        .select("op_day", "station", label.alias("hour_label"))
    )
    pick, switch, n = F.col("avg_pick_s"), F.col("avg_switch_s"), F.col("completions")
    hour = F.lit(S.HOUR_S)
    return complete_grid(grid, sums, LABELLED, {"completions": 0}).withColumns(
        {
            "implied_fixed_tph": ratio(hour, pick + S.FIXED_SWITCH_S),
            "implied_actual_tph": ratio(hour, pick + switch),
            "util_fixed_pct": ratio(n * (pick + S.FIXED_SWITCH_S), hour) * 100,
            "util_actual_pct": F.when(
                pick + switch > 0, ratio(n * (pick + switch), hour) * 100
            ),
        }
    )


def pick_matrix(t: Tables) -> DataFrame:
    """Average pick and pick count per station and arrival hour over 24 hours."""
    picks = pick_intervals(t, all_robots=True)
    cells = picks.groupBy(*CELL).agg(
        F.avg("pick_s").alias("avg_pick_s"), F.count("*").alias("picks")
    )
    days = picks.groupBy("op_day").agg(floor_to(F.min("hour"), "DAY").alias("day_ts"))
    grid = ticks(t.day_stations().join(days, "op_day"), "HOUR", 24, "hour")
    return complete_grid(grid, cells, CELL, {"picks": 0}).drop("day_ts")
