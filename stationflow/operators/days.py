"""Choice of the operational day."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.tables import Tables

TASK_TIMES = ["created_ts", "assigned_ts", "loaded_ts", "unloaded_ts", "completed_ts"]


def peak_day(callback: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Date with most callback rows, per load if ``by`` names it; ties go to the first."""
    dated = callback.withColumn("date", F.to_date("ts")).where(F.col("date").isNotNull())
    sizes = dated.groupBy(*by, "date").agg(F.count("*").alias("n"))
    first = F.struct(-F.col("n"), F.col("date"))
    return sizes.groupBy(*by).agg(F.min_by("date", first).alias("op_day"))


def keep_peak_day(t: Tables, by: Sequence[str] = ()) -> Tables:
    """Only the rows of the peak day, in every table.

    With ``by`` (columns that name the load, such as ``source``) each load keeps its own
    peak day. A load whose callbacks know one date or none stays as it is, and so does
    everything without callbacks. A row is dated by its own first time: a task by its
    creation where that is known to the table.
    """
    if t.callback is None:
        return t
    dated = t.callback.withColumn("date", F.to_date("ts")).where(F.col("date").isNotNull())
    sizes = dated.groupBy(*by, "date").agg(F.count("*").alias("n"))
    peaks = (
        sizes.groupBy(*by)
        .agg(F.count("*").alias("dates"), F.min_by("date", F.struct(-F.col("n"), F.col("date"))).alias("_peak"))
        .where("dates > 1")
        .drop("dates")
    )
    peak = None if by else peaks.scalar()

    def keep(df: DataFrame | None, times: Sequence[str]) -> DataFrame | None:
        if df is None:
            return None
        date = F.to_date(next(c for c in times if c in df.columns))
        if peak is not None:
            return df.where(F.when(peak.isNull(), F.lit(True)).otherwise(date == peak))
        other = peaks.select(*[F.col(c).alias(f"_{c}") for c in by], "_peak")
        same_load = [df[c].eqNullSafe(other[f"_{c}"]) for c in by]
        marked = df.join(other, same_load, "left")
        return marked.where(F.col("_peak").isNull() | (date == F.col("_peak"))).select(
            *[df[c] for c in df.columns]
        )

    lifecycle = keep(t.lifecycle, TASK_TIMES)
    stage = t.stage
    if stage is not None and lifecycle is not None:
        # The stages of a task go with it.
        stage = stage.join(lifecycle.select("op_day", "row_id"), ["op_day", "row_id"], "left_semi")
    return replace(
        t, station_event=keep(t.station_event, ["ts"]), callback=keep(t.callback, ["ts"]), lifecycle=lifecycle, stage=stage
    )


def data_date(spark: SparkSession, t: Tables) -> DataFrame:
    """One row: earliest date of the first table, in order, that has a time."""
    first = []
    for df, times in (
        (t.callback, ["ts"]),
        (t.station_event, ["ts"]),
        (t.lifecycle, TASK_TIMES),
    ):
        if df is not None:
            known = [F.min(c) for c in times if c in df.columns]
            first.append(df.agg(F.coalesce(*known, F.lit(None)).alias("ts")).scalar())
    return spark.range(1).select(F.date_format(F.coalesce(*first), "yyyy-MM-dd").alias("data_date"))
