"""Station dimension, station lookup and the delivery robot type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.text import is_labor_point, point_coordinate


def station_points(events: DataFrame, per_day: bool = False) -> DataFrame:
    """Distinct labor points of the events, with their coordinates."""
    keys = ["op_day"] if per_day else []
    code = F.col("location_code")
    return (
        events.select(*keys, "location_code")
        .distinct()
        .where(is_labor_point(code))
        .select(
            *keys,
            "location_code",
            point_coordinate(code, 3).alias("x"),
            point_coordinate(code, 4).alias("y"),
        )
    )


def build_station_dim(
    events: DataFrame,
    overrides: DataFrame | None = None,
    names: DataFrame | None = None,
    per_day: bool = False,
) -> DataFrame:
    """``location_code, station, x, y, zone, station_ord, design_rate``.

    Stations are numbered by (y, x); each distinct y is a zone. Rows are numbered
    within a zone and shifted by the size of the zones before it, so only the
    zone list is ordered as a whole. ``overrides`` has ``kind`` (``zone`` or
    ``rate``), ``name`` and ``value``; ``names`` gives ``location_code, station``
    and replaces the derived names.
    """
    keys = ["op_day"] if per_day else []
    points = station_points(events, per_day)
    by_y = Window.partitionBy(*keys).orderBy("y")
    before = by_y.rowsBetween(Window.unboundedPreceding, -1)
    zones = (
        points.groupBy(*keys, "y")
        .agg(F.count("*").alias("_n"))
        .withColumn("_zone", F.row_number().over(by_y))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    in_zone = Window.partitionBy(*keys, "y").orderBy("x", "location_code")
    dim = (
        points.join(zones, [*keys, "y"])
        .withColumn("station_ord", (F.row_number().over(in_zone) + F.col("_shift")).cast("int"))
        .select(
            *keys,
            "location_code",
            F.concat(F.lit("LABOR-"), F.col("station_ord")).alias("station"),
            "x",
            "y",
            # Letters from A on; past the last one-byte character the number itself.
            F.concat(
                F.lit("Zone "),
                F.when(F.col("_zone") < 192, F.char(F.col("_zone") + 64)).otherwise(F.col("_zone").cast("string")),
            ).alias("zone"),
            "station_ord",
        )
    )
    if names is not None:
        named = names.select("location_code", F.col("station").alias("_name"))
        dim = dim.join(named, "location_code", "left").withColumn(
            "station", F.coalesce("_name", "station")
        ).drop("_name")
    return apply_overrides(dim, overrides)


def apply_overrides(dim: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Zone names and design rates from the user; a station's rate beats its zone's."""
    if overrides is None:
        return dim.withColumn("design_rate", F.lit(None).cast("int"))

    def entries(kind: str, name: str, value: str) -> DataFrame:
        return overrides.where(F.col("kind") == kind).select(
            F.col("name").alias(name), F.col("value").alias(value)
        )

    zoned = dim.join(entries("zone", "station", "_zone"), "station", "left").withColumn(
        "zone", F.coalesce("_zone", "zone")
    )
    rated = zoned.join(entries("rate", "station", "_own"), "station", "left").join(
        entries("rate", "zone", "_shared"), "zone", "left"
    )
    rate = F.coalesce("_own", "_shared").try_cast("double").cast("int")
    return rated.withColumn("design_rate", rate).select(*dim.columns, "design_rate")


def design_total(dim: DataFrame) -> DataFrame:
    """One row: the sum of all resolved design rates, NULL if there is none."""
    return dim.agg(F.sum("design_rate").cast("bigint").alias("design_total"))


def with_station(events: DataFrame, dim: DataFrame, how: str = "left") -> DataFrame:
    """Look up the station of each location; unknown locations get NULL."""
    on = [c for c in ("op_day", "location_code") if c in dim.columns]
    return events.join(dim.select(*on, "station"), on, how)


def detect_robot_type(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by``): the first type that holds "50", else the first type."""
    kind = F.when(F.col("robot_type").contains(S.DELIVERY_HINT), F.col("robot_type"))
    return events.where(F.col("robot_type").isNotNull()).groupBy(*by).agg(
        F.coalesce(
            F.min_by(kind, F.when(kind.isNotNull(), F.col("row_id"))),
            F.min_by("robot_type", "row_id"),
        ).alias("robot_type")
    )


def with_delivers(events: DataFrame, robot_type: str | DataFrame | None) -> DataFrame:
    """Add ``delivers``: whether ``of_type`` keeps the row."""
    if robot_type is None:
        return events.withColumn("delivers", F.lit(True))
    if isinstance(robot_type, DataFrame):
        events = events.join(robot_type.select("op_day", F.col("robot_type").alias("_type")), "op_day", "left")
    else:
        events = events.withColumn("_type", F.lit(robot_type))
    delivers = F.col("_type").isNull() | (F.col("robot_type") == F.col("_type"))
    return events.withColumn("delivers", F.coalesce(delivers, F.lit(False))).drop("_type")


def of_type(events: DataFrame, robot_type: str | DataFrame | None) -> DataFrame:
    """Events of one robot type, or of the type of their day; all of them if none is known."""
    if robot_type is None:
        return events
    if isinstance(robot_type, DataFrame):
        chosen = robot_type.select("op_day", F.col("robot_type").alias("_type"))
        return events.join(chosen, "op_day", "left").where(
            F.col("_type").isNull() | (F.col("robot_type") == F.col("_type"))
        ).drop("_type")
    return events.where(F.col("robot_type") == robot_type)


def completions(events: DataFrame) -> DataFrame:
    """triggerGo events at known stations (``events`` already has ``station``)."""
    return events.where((F.col("event_type") == S.TRIGGER_GO) & F.col("station").isNotNull())
