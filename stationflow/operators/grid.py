"""Complete a sparse result to a full time grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.functions.times import floor_to


def day_start(cells: DataFrame, time: str = "hour", keys: Sequence[str] = ("op_day",)) -> DataFrame:
    """Add ``day_ts``: midnight of the earliest hour of the day's cells."""
    first = cells.groupBy(*keys).agg(floor_to(F.min(time), "DAY").alias("day_ts"))
    return cells.join(first, list(keys))


def ticks(rows: DataFrame, unit: str, count: int, out: str) -> DataFrame:
    """Repeat each row for ``count`` steps of ``unit`` from its ``day_ts``."""
    last = F.col("day_ts") + F.expr(f"INTERVAL {count - 1} {unit}")
    return rows.withColumn(
        out, F.explode(F.sequence(F.col("day_ts"), last, F.expr(f"INTERVAL 1 {unit}")))
    )


def complete_grid(
    grid: DataFrame, cells: DataFrame, on: Sequence[str], fill: Mapping[str, Any] | None = None
) -> DataFrame:
    """Left join ``cells`` to ``grid`` and fill what is missing."""
    out = grid.join(cells, list(on), "left")
    return out.fillna(dict(fill)) if fill else out
