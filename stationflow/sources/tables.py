"""Tabular sources: recognise, rename and type them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stationflow import schemas as S
from stationflow.operators import quality
from stationflow.sources import sinks
from stationflow.tables import Tables


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet unless the path ends in ``.csv`` or ``.json``.

    ``row_id`` is the place of a row in its file, whatever task reads it; rows of one
    split keep their order.
    """
    end = path.rstrip("/")
    if end.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
    elif end.endswith(".json"):
        df = spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    if "row_id" in df.columns:
        return df
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return df.select("*", place.alias("row_id"))


def recognise(columns: Sequence[str]) -> str | None:
    """Kind of a table by its columns."""
    names = set(columns)
    timed = {S.TOTAL_COLUMN, S.K50_LEG_COLUMN} & names
    if set(S.REQUIRED_COLUMNS["callback"]) <= names:
        return "callback"
    if set(S.REQUIRED_COLUMNS["station"]) <= names and not timed:
        return "station"
    return "lifecycle" if timed else None


def _named(df: DataFrame, name: str) -> DataFrame:
    return df if "source" in df.columns else df.withColumn("source", F.lit(name))


def identify(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Kind -> table: by columns, else by name. Only schemas are looked at.

    Several tables of a kind are united by column name; ``source`` keeps the name each
    row came from. Callback and station must be there; lifecycle is optional.
    """
    found: dict[str, list[DataFrame]] = {}
    for name, df in tables.items():
        kind = recognise(df.columns)
        if kind:
            found.setdefault(kind, []).append(_named(df, name))
    for kind, name in S.FALLBACK_NAMES.items():
        if kind not in found and name in tables:
            found[kind] = [_named(tables[name], name)]
    kinds = {
        kind: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        for kind, parts in found.items()
    }
    missing = [k for k in ("callback", "station") if k not in kinds]
    if missing:
        raise ValueError(
            f"no table looks like {', '.join(missing)}; tables given: {', '.join(tables) or 'none'}"
        )
    return kinds


def find_column(columns: Sequence[str], *fragments: str) -> str | None:
    """First column that holds the first fragment, else the next fragment, ..."""
    return next((c for part in fragments for c in columns if part in c), None)


def _number(column: str) -> Column:
    return F.col(f"`{column}`").cast("string").try_cast("double")


def _canonical(
    df: DataFrame, schema: StructType, source: Mapping[str, str], time: str, **extra: Column
) -> DataFrame:
    """Rename by exact name, else by fragment, and cast; missing columns are NULL.

    ``op_day`` is the date of ``time`` and ``row_id`` the input order, unless the
    table has them.
    """
    kinds = {f.name: f.dataType for f in schema.fields}

    def column(old: str, new: str) -> Column:
        found = old if old in df.columns else find_column(df.columns, old)
        value = F.col(f"`{found}`").cast("string") if found else F.lit(None).cast("string")
        return value.try_cast(kinds[new]).alias(new)

    given = [c for c in ("op_day", "row_id", "source") if c in df.columns]
    out = df.select(
        *given,
        *[column(old, new) for old, new in source.items()],
        *[c.alias(n) for n, c in extra.items()],
    )
    if "op_day" not in given:
        out = out.withColumn("op_day", F.to_date(time))
    if "row_id" not in given:
        out = out.withColumn("row_id", F.monotonically_increasing_id())
    kept = ["source"] if "source" in given else []
    return out.select("op_day", "row_id", *source.values(), *extra, *kept)


def canonical_callback(df: DataFrame) -> DataFrame:
    return _canonical(df, S.CALLBACK, S.CALLBACK_COLUMNS, "ts")


def canonical_station(df: DataFrame) -> DataFrame:
    return _canonical(df, S.STATION_EVENT, S.STATION_COLUMNS, "ts")


def stage_columns(columns: Sequence[str]) -> list[str]:
    """Duration columns other than the total, in table order."""
    return [c for c in columns if S.DURATION_MARK in c and c != S.TOTAL_COLUMN]


def used_stages(df: DataFrame) -> list[str]:
    """Stage columns with any value; one aggregate over all of them."""
    stages = stage_columns(df.columns)
    if not stages:
        return []
    counts = df.agg(*[F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(stages)]).first()
    return [c for i, c in enumerate(stages) if counts[str(i)]]


def stage_label(stage: Column, labels: Mapping[str, str] = S.STAGE_LABELS) -> Column:
    """Label of a stage column: from the table of labels, else its name without the unit.

    A name without a label that starts with a fleet code gets a dash behind the code.
    """
    bare = F.trim(F.replace(stage, F.lit(S.STAGE_SUFFIX), F.lit("")))
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    dashed = F.regexp_replace(bare, r"^([A-Za-z0-9]+)(?=[^A-Za-z0-9])", "$1 - ")
    return F.coalesce(F.try_element_at(known, bare), dashed)


def leg_column(
    columns: Sequence[str], robot_type: str | None, stages: Sequence[str]
) -> str | None:
    """Delivery-leg column: of the robot type, else any, else the last stage."""
    own = f"{robot_type or S.DEFAULT_DELIVERY_TYPE}{S.LEG_MARK}"
    return find_column(columns, own, S.LEG_MARK) or (stages[-1] if stages else None)


def canonical_lifecycle(
    df: DataFrame, robot_type: str | None = None, stages: Sequence[str] | None = None
) -> DataFrame:
    """Lifecycle rows with ``leg_s`` and, if the table has shuttle stages, ``shuttle_s``."""
    stages = stage_columns(df.columns) if stages is None else stages
    leg = leg_column(df.columns, robot_type, stages)
    zero = F.lit(0.0)
    parts = [
        F.greatest(F.coalesce(_number(c), zero), zero)
        for c in stage_columns(df.columns)
        if S.SHUTTLE_MARK in c
    ]
    extra = {"leg_s": _number(leg) if leg else F.lit(None).cast("double")}
    if parts:
        extra["shuttle_s"] = sum(parts[1:], parts[0])
    return _canonical(df, S.LIFECYCLE, S.LIFECYCLE_COLUMNS, "completed_ts", **extra)


def lifecycle_stages(
    df: DataFrame, stages: Sequence[str] | None = None, labels: Mapping[str, str] = S.STAGE_LABELS
) -> DataFrame:
    """Long stage rows ``op_day, task, ..., stage, stage_label, stage_ord, seconds``."""
    stages = stage_columns(df.columns) if stages is None else stages
    cells = [
        F.struct(
            F.lit(c).alias("stage"),
            stage_label(F.lit(c), labels).alias("stage_label"),
            F.lit(i).alias("stage_ord"),
            _number(c).alias("seconds"),
        )
        for i, c in enumerate(stages, start=1)
    ]
    if not cells:
        raise ValueError("the table has no stage duration columns")
    rows = _canonical(
        df, S.LIFECYCLE, S.LIFECYCLE_COLUMNS, "completed_ts", _cells=F.array(*cells)
    )
    return rows.select(
        "op_day", "row_id", "task_code", "dest_loc", "completed_ts", "total_s", F.inline("_cells")
    )


def _typed(
    kinds: Mapping[str, DataFrame], overrides: DataFrame | None, robot_type: str | None
) -> Tables:
    events = canonical_station(kinds["station"])
    # The delivery leg of a table is that of its main type; events go by the type of their day.
    main_type = Tables(events, overrides=overrides, given_type=robot_type).robot_type
    lifecycle = stage = None
    if "lifecycle" in kinds:
        raw = kinds["lifecycle"]
        stages = used_stages(raw)
        lifecycle = canonical_lifecycle(raw, main_type, stages)
        stage = lifecycle_stages(raw, stages) if stages else None
    return Tables(
        events, canonical_callback(kinds["callback"]), lifecycle, stage, overrides,
        given_type=robot_type,
    )


def read_tables(
    spark: SparkSession, paths: Mapping[str, str], overrides: DataFrame | None = None,
    robot_type: str | None = None,
) -> Tables:
    """Read named tables, tell which is which and make them canonical. Nothing is checked."""
    return _typed(identify({name: read_table(spark, path) for name, path in paths.items()}), overrides, robot_type)


def load_tables(
    spark: SparkSession, paths: Mapping[str, str], folder: str, overrides: DataFrame | None = None,
    robot_type: str | None = None, strict: bool = True,
) -> tuple[Tables, DataFrame]:
    """Read named tables, write them canonical to ``folder``, and check them in that same pass.

    Gives the stored tables and the issues found (``severity, table, check, detail``). With
    ``strict`` an error raises ``quality.BadData``; the tables written stay, for a look at them.
    """
    kinds = identify({name: read_table(spark, path) for name, path in paths.items()})
    lacking = [c for kind, df in kinds.items() for c in S.REQUIRED_COLUMNS.get(kind, ()) if c not in df.columns]
    if lacking:
        raise ValueError(f"required columns are missing: {', '.join(lacking)}")
    watch = quality.Watch()
    t = _typed({kind: watch.table(kind, df) for kind, df in kinds.items()}, overrides, robot_type)
    t = replace(t, callback=watch.days(t.callback))
    sinks.write_raw(t, folder, by_day=False)
    issues = watch.issues(spark)
    if strict:
        quality.require_sound(issues)
    return read_canonical(spark, folder, overrides, robot_type=robot_type), issues


def read_stored(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """A table by its folder, or None where none was written."""
    try:
        return spark.read.option("header", True).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_canonical(
    spark: SparkSession, folder: str, overrides: DataFrame | None = None, fmt: str = "parquet",
    robot_type: str | None = None,
) -> Tables:
    """The canonical tables that ``sinks.write_raw`` wrote; tables that are not there stay out.

    A table is looked for by its folder name through Spark's own file system.
    """
    kinds = {"station_event": S.STATION_EVENT, "callback": S.CALLBACK, "lifecycle": S.LIFECYCLE, "stage": S.LIFECYCLE_STAGE}
    found: dict[str, DataFrame] = {}
    for name, out in S.RAW_NAMES.items():
        df = read_stored(spark, f"{folder}/{out}", fmt)
        if df is None:
            continue
        types = {f.name: f.dataType for f in kinds[name].fields if f.name != "row_id"}
        found[name] = df.select(
            *[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
        )
    if not found:
        raise ValueError(f"no canonical table lies in {folder}")
    return Tables(**found, overrides=overrides, given_type=robot_type)
