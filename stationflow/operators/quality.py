"""Data-quality checks: rows ``severity, table, check, detail``."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stationflow import schemas as S

MIN_ROWS = 10
ISSUE = "severity STRING, table STRING, check STRING, detail STRING"


def _issue(severity: str, table: str, check: str, detail: Column | str) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(table).alias("table"),
        F.lit(check).alias("check"),
        text.cast("string").alias("detail"),
    )


def time_column(columns: list[str]) -> str | None:
    """First column whose name says time."""
    return next((c for c in columns if any(mark in c for mark in S.TIME_MARKS)), None)


def schema_issues(kind: str, columns: list[str]) -> list[Column]:
    """Missing columns, from the schema alone."""
    found = [
        _issue("error", kind, "required_column", c)
        for c in S.REQUIRED_COLUMNS[kind]
        if c not in columns
    ]
    found += [
        _issue("warning", kind, "expected_column", c)
        for c in S.EXPECTED_COLUMNS[kind]
        if c not in columns
    ]
    if kind == "lifecycle" and not any(S.DURATION_MARK in c for c in columns):
        found.append(_issue("error", kind, "duration_column", S.DURATION_MARK))
    return found


def _measures(columns: list[str]) -> list[Column]:
    """What the checks of a table count: its rows and its readable times."""
    time = time_column(columns)
    parsed = F.col(f"`{time}`").cast("string").try_cast("timestamp_ntz") if time else F.lit(1)
    return [F.count(F.lit(1)).alias("rows"), F.count(parsed).alias("good")]


def _count_issues(kind: str, columns: list[str], rows: Column, good: Column) -> Column:
    time = time_column(columns)
    issues = [
        *schema_issues(kind, columns),
        F.when(rows == 0, _issue("error", kind, "empty", rows)),
        F.when((rows > 0) & (rows < MIN_ROWS), _issue("warning", kind, "few_rows", rows)),
    ]
    if time:
        bad_pct = F.bround((1 - F.try_divide(good, rows)) * 100).cast("bigint")
        issues += [
            F.when(good == 0, _issue("error", kind, "no_timestamps", time)),
            F.when(
                (good > 0) & (good < rows * 0.5), _issue("warning", kind, "bad_timestamps", bad_pct)
            ),
        ]
    return F.array_compact(F.array(*issues))


def check_table(kind: str, df: DataFrame) -> DataFrame:
    """All checks of one table from a single aggregate."""
    counted = df.agg(*_measures(df.columns))
    return counted.select(F.inline(_count_issues(kind, df.columns, F.col("rows"), F.col("good"))))


class BadData(ValueError):
    """Data with errors; ``issues`` lists all that was found."""

    def __init__(self, issues: DataFrame, errors: list[str]):
        super().__init__("; ".join(errors))
        self.issues = issues


class Watch:
    """Checks of tables while they are read for another purpose: they cost no scan.

    ``table`` gives the table to go on with; ``issues`` the rows of all checks, once a job
    has read every watched table.
    """

    def __init__(self):
        self.seen: dict[str, tuple[Observation, list[str]]] = {}
        self.loads: Observation | None = None

    def table(self, kind: str, df: DataFrame) -> DataFrame:
        found = Observation()
        self.seen[kind] = found, df.columns
        return df.observe(found, *_measures(df.columns))

    def days(self, loads: DataFrame) -> DataFrame:
        """Watch for days from more than one source; ``loads`` has ``op_day, source``."""
        self.loads = Observation()
        # Days and sources are few, whatever the number of rows.
        return loads.observe(self.loads, F.collect_set(F.struct("op_day", "source")).alias("loads"))

    def issues(self, spark: SparkSession) -> DataFrame:
        parts = [spark.createDataFrame([], ISSUE)]
        for kind, (found, columns) in self.seen.items():
            n = found.get
            counted = spark.range(1).select(F.lit(n["rows"]).alias("rows"), F.lit(n["good"]).alias("good"))
            parts.append(counted.select(F.inline(_count_issues(kind, columns, F.col("rows"), F.col("good")))))
        if self.loads is not None:
            rows = [(x["op_day"], x["source"]) for x in self.loads.get["loads"] or []]
            parts.append(duplicate_days(spark.createDataFrame(rows, "op_day DATE, source STRING")))
        return reduce(DataFrame.unionByName, parts)


def require_sound(issues: DataFrame) -> DataFrame:
    """Raise ``BadData`` if any issue is an error."""
    rows = issues.where("severity = 'error'").collect()
    if rows:
        raise BadData(issues, [f"{r.table}: {r.check} ({r.detail})" for r in rows])
    return issues


def check_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Callback and station must be there; lifecycle is checked when given."""
    missing = [
        ("error", kind, "missing_table", kind)
        for kind in ("callback", "station")
        if kind not in tables
    ]
    parts = [check_table(kind, df) for kind, df in tables.items()]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame(missing, ISSUE))


def duplicate_days(loads: DataFrame) -> DataFrame:
    """Days that come from more than one source; ``loads`` has ``op_day, source``."""
    sources = F.count_distinct("source")
    return (
        loads.groupBy("op_day")
        .agg(sources.alias("sources"))
        .where(F.col("sources") > 1)
        .select(
            F.lit("warning").alias("severity"),
            F.lit("callback").alias("table"),
            F.lit("duplicate_day").alias("check"),
            F.col("op_day").cast("string").alias("detail"),
        )
    )
