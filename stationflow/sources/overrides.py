"""User settings: zone names, design rates and the delivery robot type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow import schemas as S

OBJECTS = ("station_types", "design_rates", "type_colors")
_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """The settings file as one row with its ``text``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def _issue(severity: str, check: str, detail):
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit("overrides").alias("table"),
        F.lit(check).alias("check"),
        detail.alias("detail"),
    )


def check_settings(settings: DataFrame) -> DataFrame:
    """Issues of the settings: unknown keys warn, wrong types are errors."""
    parsed = settings.select("text", F.try_parse_json("text").alias("v"))
    kind = F.schema_of_variant("v")

    def part(name: str):
        return F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))

    unknown = F.array_except(F.json_object_keys("text"), F.array(*map(F.lit, S.OVERRIDE_KEYS)))
    is_object = kind.startswith("OBJECT")
    rates = F.map_entries(F.try_variant_get("v", "$.design_rates", "map<string,variant>"))
    bad_rates = F.transform(
        F.filter(rates, lambda e: ~F.schema_of_variant(e["value"]).rlike(_NUMBER)),
        lambda e: e["key"],
    )
    issues = F.array(
        F.when(
            F.col("v").isNull() | ~is_object,
            _issue("error", "json_object", F.lit("settings must be a JSON object")),
        ),
        F.when(
            is_object & (F.size(unknown) > 0),
            _issue("warning", "unknown_keys", F.array_join(F.array_sort(unknown), ", ")),
        ),
        *[
            F.when(
                ~part(name).startswith("OBJECT") & (part(name) != "VOID"),
                _issue("error", "object", F.lit(name)),
            )
            for name in OBJECTS
        ],
        F.when(
            ~part("amr_type").isin("STRING", "VOID"), _issue("error", "string", F.lit("amr_type"))
        ),
        F.when(
            F.size(bad_rates) > 0,
            _issue("error", "numeric_rate", F.array_join(F.array_sort(bad_rates), ", ")),
        ),
    )
    return parsed.select(F.inline(F.array_compact(issues)))


def parse_overrides(settings: DataFrame) -> DataFrame:
    """Rows ``kind, name, value``: kind is ``zone``, ``rate`` or ``robot_type``.

    Settings with errors give no rows.
    """
    fields = "station_types MAP<STRING,STRING>, design_rates MAP<STRING,STRING>, amr_type STRING"
    errors = check_settings(settings).where(F.col("severity") == "error")
    s = F.from_json("text", fields)
    none = F.create_map().cast("map<string,string>")

    def rows(kind: str, values):
        return F.transform(
            F.map_entries(F.coalesce(values, none)),
            lambda e: F.struct(
                F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("value")
            ),
        )

    robot = F.when(
        s["amr_type"].isNotNull(), F.create_map(F.lit("amr_type"), s["amr_type"])
    )
    every = F.concat(
        rows("zone", s["station_types"]), rows("rate", s["design_rates"]), rows("robot_type", robot)
    )
    return settings.select(F.inline(every)).where(errors.agg(F.count("*") == 0).scalar())
