"""Interval overlap and stabbing counts without a theta join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions.times import floor_div, from_micros, to_micros
from stationflow.operators.ordered import BLOCK_S, running_totals

BIN_US = 300_000_000


def overlap_count(
    intervals: DataFrame,
    keys: Sequence[str],
    ident: str,
    start: str,
    end: str,
    out: str = "depth",
    block_s: int = BLOCK_S,
) -> DataFrame:
    """Add ``out``: intervals of the same ``keys`` that meet this one, itself included.

    Ends are closed. For an interval [s, e] the count is
    #(starts up to e) - #(ends before s); both are running counts over the merged
    endpoints, where starts come before ends of the same instant. ``ident`` is
    unique per interval within ``keys``.
    """
    rest = [c for c in intervals.columns if c not in keys]
    is_end = F.col("side") == 1
    points = intervals.select(
        *keys, F.col(ident).alias("_id"), F.struct(*rest).alias("_row"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    ).select(
        *keys, "_id", "side",
        to_micros(F.when(is_end, F.col("_row")[end]).otherwise(F.col("_row")[start])).alias("us"),
        F.when(is_end, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("starts"),
        F.when(is_end, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("ends"),
        F.when(is_end, F.col("_row")).alias("_row"),
    )
    counted = running_totals(points, keys, ["us", "side"], ["starts", "ends"], block_s)
    return (
        counted.groupBy(*keys, "_id")
        .agg(
            F.sum(F.when(F.col("side") == 1, F.col("starts")).otherwise(-F.col("ends"))).alias(out),
            F.first("_row", ignorenulls=True).alias("_row"),
        )
        .select(*keys, "_row.*", out)
    )


def bin_span(events: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """First and last 5-minute bin that the events of each key touch.

    The span runs from the first time rounded down to the last time rounded up.
    """
    low, high = to_micros(F.min(ts)), to_micros(F.max(ts))
    return (
        events.groupBy(*keys)
        .agg(low.alias("_low"), high.alias("_high"))
        .select(
            *keys,
            floor_div(F.col("_low"), BIN_US).alias("first_bin"),
            floor_div(F.col("_high") - 1, BIN_US).alias("last_bin"),
        )
    )


def active_at(
    intervals: DataFrame, keys: Sequence[str], grid: DataFrame, start: str, end: str
) -> DataFrame:
    """Intervals that contain the midpoint of each 5-minute bin of ``grid``.

    ``grid`` has ``keys, first_bin, last_bin``. Each interval adds one at the
    first bin whose midpoint it holds and takes one away after the last; these
    steps are summed per bin before the running sum.
    """
    half = BIN_US // 2
    spans = intervals.select(
        *keys,
        (-floor_div(-(to_micros(F.col(start)) - half), BIN_US)).alias("_from"),
        floor_div(to_micros(F.col(end)) - half, BIN_US).alias("_to"),
    ).where(F.col("_from") <= F.col("_to"))
    steps = spans.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("_from").alias("bin"), F.lit(1).cast("bigint").alias("step")),
                F.struct((F.col("_to") + 1).alias("bin"), F.lit(-1).cast("bigint").alias("step")),
            )
        ),
        F.lit(False).alias("shown"),
    )
    ticks = grid.select(
        *keys,
        F.explode(F.sequence("first_bin", "last_bin")).alias("bin"),
        F.lit(0).cast("bigint").alias("step"),
        F.lit(True).alias("shown"),
    )
    upto = (
        Window.partitionBy(*keys)
        .orderBy("bin")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        steps.unionByName(ticks)
        .groupBy(*keys, "bin")
        .agg(F.sum("step").alias("step"), F.max("shown").alias("shown"))
        .withColumn("active", F.sum("step").over(upto))
        .where("shown")
        .select(*keys, from_micros(F.col("bin") * BIN_US + half).alias("mid_ts"), "active")
    )
