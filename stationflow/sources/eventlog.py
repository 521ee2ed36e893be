"""Event-log text to the three canonical tables.

An entry is ``[time][level][app][env][category][EVENT] - {json}``. Entries keep
their place as ``row_id`` = struct(file, block, line, part): ordered, unique and
known without a global sort. Rows made from an entry add their ``kind`` to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.text import is_labor, robot_type_of
from stationflow.functions.times import parse_epoch_ms, parse_iso, seconds_between, zone_offset
from stationflow.operators.ordered import running_totals
from stationflow.sources.sinks import write_raw
from stationflow.session import settle, written
from stationflow.sources.tables import read_canonical, read_stored
from stationflow.tables import Tables

# ---------------------------------------------------------------------------
# The log format, its event names and its JSON fields.
ENTRY_START = r"(?=\[\d{4}-\d{2}-\d{2}T)"
# Text with no entry start after its first character; possessive, so one run over the text decides.
ONE_CHUNK = r"(?s)^.[^\[]*+(?:\[(?!\d{4}-\d{2}-\d{2}T)[^\[]*+)*+\z"
ENTRY = r"(?s)^\s*\[([^\]]+)\]\[\d+\]\[[^\]]+\]\[[^\]]+\]\[[^\]]+\]\[([^\]]+)\]\s*-\s*(.+)"
FILE_DATE = r"(\d{4}-\d{2}-\d{2})"
CALLBACK_SENT = "TASK_EXECUTION_CALLBACK_SENT"
BUSINESS_CHANGE = "BUSINESS_TASK_DATA_CHANGE"
TOTE_LOADED = "CALLBACK_OF_TOTE_LOADED_BY_ROBOT"
TOTE_UNLOADED = "CALLBACK_OF_TOTE_UNLOADED_BY_ROBOT"
TASK_FINISHED = "CALLBACK_OF_TASK_FINISHED"
STATION_REACHED = "CALLBACK_OF_ROBOT_REACH_STATION"
UNNAMED_ACTION = "robot"
MANIFEST = "manifest"
ASSIGN_COLUMN = "分配耗时(秒)"
PAYLOAD = "taskCode STRING, containerCode STRING, taskGroupCode STRING, fromLocationCode STRING, data STRING"
DATA = """
    name STRING, message STRING, id STRING, assignedRobotCode STRING, finalToStationCode STRING,
    nextDestination STRING, wmsTaskCreated STRING, assignedTime STRING, loadTime STRING,
    unloadTime STRING, completedTime STRING
"""
MESSAGE = """
    stationCode STRING, locationCode STRING, robotCode STRING, actionCode STRING,
    taskGroupCode STRING, callId STRING
"""
# ---------------------------------------------------------------------------

MARK = "\u0001"
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
STARTS = r"^\[\d{4}-\d{2}-\d{2}T"


def file_date(name: Column) -> Column:
    """Date in a file name, NULL if there is none."""
    return F.nullif(F.regexp_extract(name, FILE_DATE, 1), F.lit("")).try_cast("date")


def read_event_log(
    spark: SparkSession, paths: str | Sequence[str], multiline: bool = True, whole: bool = False
) -> DataFrame:
    """Parsed entries of one or many log files, in file-name order.

    An entry reaches up to the next one, so a payload may span lines, and stray text after
    an entry makes it unreadable. Without ``multiline`` an entry ends with its line.
    With ``whole`` a column ``body`` keeps the payload with all its fields (``payload_field``).
    """
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return _parse_chunks(_glued(_chunks(lines)) if multiline else _chunks(lines), whole)


def _chunks(lines: DataFrame) -> DataFrame:
    """Lines cut where an entry starts; most hold one entry and need no cut."""
    parts = F.when(F.col("value").rlike(ONE_CHUNK), F.array("value")).otherwise(F.split("value", ENTRY_START))
    return lines.select("file_name", "block", "line", F.posexplode(parts).alias("part", "chunk"))


def _glued(chunks: DataFrame) -> DataFrame:
    """Each entry start with the lines up to the next one.

    Starts are numbered per file by running totals over its blocks, so no task holds a
    file, and the lines of one number are put together.
    """
    place = ["block", "line", "part"]
    started = chunks.withColumn("entry", F.col("chunk").rlike(STARTS).cast("bigint"))
    numbered = running_totals(started, ["file_name"], place, ["entry"], block_s=1).where("entry > 0")
    parts = F.sort_array(F.collect_list(F.struct(*place, "chunk")))
    text = F.transform(
        "parts", lambda x, i: F.when((i > 0) & (x["part"] == 0), F.concat(F.lit("\n"), x["chunk"])).otherwise(x["chunk"])
    )
    return (
        numbered.groupBy("file_name", "entry")
        .agg(parts.alias("parts"))
        .select(
            "file_name", *[F.col("parts")[0][c].alias(c) for c in place], F.array_join(text, "").alias("chunk")
        )
    )


def require_entries(entries: DataFrame) -> DataFrame:
    """Raise if the log holds no readable entry."""
    if entries.isEmpty():
        raise ValueError("no readable log entries were found")
    return entries


def parse_entries(lines: DataFrame, whole: bool = False) -> DataFrame:
    """``op_day, label, row_id, ts, offset_s, event, payload`` of each well-formed entry.

    ``lines`` has ``value, file_name, block, line``; here an entry ends with its line.
    With ``whole`` there is also ``body``, the payload as a variant.
    """
    return _parse_chunks(_chunks(lines), whole)


def payload_field(path: str, kind: str = "string", column: str = "body") -> Column:
    """A field of ``body`` by its path (``$.data.route[0]``), as the named type.

    For fields that no table is built from. A field that is missing, or whose value the type
    cannot hold, is NULL; ``variant`` gives lists and objects as they are. A body that holds
    one key twice is NULL as a whole.
    """
    return F.try_variant_get(column, path, kind)


def message_field(path: str, kind: str = "string", column: str = "body") -> Column:
    """A field of the JSON text that callbacks carry in ``data.message``."""
    return F.try_variant_get(F.try_parse_json(payload_field("$.data.message", column=column)), path, kind)


def _parse_chunks(chunks: DataFrame, whole: bool = False) -> DataFrame:
    """Text that is no entry and payloads that are no JSON object as a whole are dropped.

    A field is read on its own: one of another type is its JSON text, or NULL where a
    list is wanted. ``op_day`` is the date in the file name, else the entry's own date;
    ``label`` names the day or file; ``offset_s`` is the zone of the entry's clock.
    """
    # One run of the pattern marks the three parts; text that is no entry stays whole.
    marked = F.regexp_replace("chunk", F.lit(ENTRY), F.lit(f"$1{MARK}$2{MARK}$3"))
    found = chunks.select(
        "file_name", "block", "line", "part",
        F.explode(F.array(F.split(marked, MARK, 3))).alias("field"),
    ).where(F.size("field") == 3)
    json = F.trim(F.col("field")[2], F.lit(" \t\r\n"))
    day = file_date(F.col("file_name"))
    body = [F.try_parse_json(json).alias("body")] if whole else []

    def texts(name: str) -> Column:
        return F.from_json(name, "array<string>").alias(name.rsplit(".", 1)[-1])

    data = [F.col(f"inner.{n}").alias(n) for n in (
        "name", "message", "id", "assignedRobotCode", "finalToStationCode", "wmsTaskCreated",
        "assignedTime", "loadTime", "unloadTime", "completedTime",
    )]
    return (
        found.select(
            day.alias("_day"),
            F.coalesce(day.cast("string"), "file_name").alias("label"),
            F.struct(F.col("file_name").alias("file"), "block", "line", "part").alias("row_id"),
            parse_iso(F.col("field")[0]).alias("ts"),
            zone_offset(F.col("field")[0]).alias("offset_s"),
            F.col("field")[1].alias("event"),
            _whole_object(json, PAYLOAD).alias("outer"),
            *body,
        )
        .select("*", _parse_once(F.coalesce("outer.data", F.lit("{}")), DATA).alias("inner"))
        .select(
            F.coalesce("_day", F.to_date("ts")).alias("op_day"), "label", "row_id", "ts", "offset_s", "event",
            F.struct(
                texts("outer.taskCode"), texts("outer.containerCode"), F.col("outer.taskGroupCode").alias("taskGroupCode"),
                F.col("outer.fromLocationCode").alias("fromLocationCode"),
                F.struct(*data, texts("inner.nextDestination")).alias("data"),
            ).alias("payload"),
            *(["body"] if whole else []),
        )
    )


def _parse_once(text: Column, schema: str) -> Column:
    """Parsed JSON as a generated column, so that no filter repeats the parsing."""
    return F.explode(F.array(F.from_json(text, schema)))


def _whole_object(text: Column, schema: str) -> Column:
    """Parsed text that is one JSON object as a whole; a generator, so that other text gives no row.

    The text is parsed once, as the only element of a list: text before or after it makes the
    list unreadable or longer, and so do single quotes and bare control characters. A filter
    on other columns, as on the event, comes first.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{_fields(schema)}>>", STRICT)
    alone = F.filter(F.array(F.when(text.startswith("{"), listed)), lambda x: F.size(x) == 1)
    return F.explode(F.flatten(alone))


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (c.split() for c in schema.split(",")))


def _ordinal(row_id: Column, part: Column | int) -> Column:
    """``row_id`` for the n-th row made from one entry."""
    n = F.lit(part) if isinstance(part, int) else part
    return F.struct(
        row_id["file"].alias("file"), row_id["block"].alias("block"), row_id["line"].alias("line"),
        row_id["part"].alias("part"), n.cast("int").alias("kind"),
    )


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _first_text(*values: Column) -> Column:
    """First value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _callbacks(entries: DataFrame, *names: str) -> DataFrame:
    sent = entries.where(
        (F.col("event") == CALLBACK_SENT) & F.col("payload.data.name").isin(*names)
    )
    return sent.select("*", _parse_once(F.col("payload.data.message"), MESSAGE).alias("msg"))


def _msg(name: str) -> Column:
    return _text(F.col(f"msg.{name}"))


def build_callback(entries: DataFrame) -> DataFrame:
    """Tote loaded, tote unloaded and task finished; the last only at labor stations."""
    finished = F.col("payload.data.name") == TASK_FINISHED
    rows = _callbacks(entries, TOTE_LOADED, TOTE_UNLOADED, TASK_FINISHED)
    action = F.when(finished, S.COMPLETE).otherwise(
        F.coalesce("msg.actionCode", F.lit(UNNAMED_ACTION))
    )
    return rows.where(~finished | is_labor(_msg("stationCode"))).select(
        "op_day",
        _ordinal(F.col("row_id"), 0).alias("row_id"),
        "ts",
        action.alias("action"),
        _first_text(F.col("payload.taskGroupCode"), F.col("msg.taskGroupCode")).alias("task_group"),
        _text(F.try_element_at("payload.taskCode", F.lit(1))).alias("task_code"),
        _msg("robotCode").alias("robot_id"),
        _text(F.try_element_at("payload.containerCode", F.lit(1))).alias("container_id"),
        _msg("locationCode").alias("location_code"),
        _msg("stationCode").alias("location_type"),
        _first_text(F.col("msg.callId"), F.col("payload.data.id")).alias("callback_id"),
        robot_type_of(_msg("locationCode")).alias("robot_type"),
    )


def build_station_event(entries: DataFrame) -> DataFrame:
    """Arrivals, and two events per finished task; equal events are kept once.

    The first of equal events gives the ``row_id``. Locations play no part in
    the robot type here.
    """
    reached = F.col("payload.data.name") == STATION_REACHED
    kinds = F.when(reached, F.array(F.lit(S.ARRIVED))).otherwise(
        F.array(F.lit(S.TRIGGER_GO), F.lit(S.RELEASE))
    )
    rows = (
        _callbacks(entries, STATION_REACHED, TASK_FINISHED)
        .where(is_labor(_msg("stationCode")))
        .select(
            "op_day",
            "row_id",
            "ts",
            _first_text(F.col("msg.locationCode"), F.col("msg.stationCode")).alias("location_code"),
            _msg("robotCode").alias("robot_id"),
            F.posexplode(kinds).alias("kind", "event_type"),
        )
    )
    return (
        rows.withColumn("row_id", _ordinal(F.col("row_id"), F.col("kind")))
        .groupBy("op_day", "ts", "event_type", "location_code", "robot_id")
        .agg(F.min("row_id").alias("row_id"))
        .select(
            "op_day", "row_id", "ts", "event_type", "location_code", "robot_id",
            robot_type_of(F.lit("")).alias("robot_type"),
        )
    )


def build_lifecycle(entries: DataFrame, zone: str | None = None) -> DataFrame:
    """Fold the state changes of each ``ND`` task into one row.

    Tasks are folded per load (``label``: the day of the file name, else the file), so an
    undated file keeps tasks that run over midnight whole; their day is that of their
    first entry. Epoch times go to the clock of the entry that holds them, or to ``zone``.

    Container, robot and times keep their last value, group and source their
    first; the destination is the last final station, else the first next
    destination. Tasks without completion or labor destination are dropped.
    """
    code = F.try_element_at("payload.taskCode", F.lit(1))
    data = "payload.data"
    labor = {
        "final": F.col(f"{data}.finalToStationCode"),
        "next": F.try_element_at(f"{data}.nextDestination", F.lit(1)),
    }
    changes = entries.where((F.col("event") == BUSINESS_CHANGE) & code.startswith("ND")).select(
        "op_day", "label",
        _ordinal(F.col("row_id"), 0).alias("row_id"),
        code.alias("task_code"),
        _text(F.col("payload.taskGroupCode")).alias("task_group"),
        F.try_element_at("payload.containerCode", F.lit(1)).alias("container"),
        F.nullif(F.col(f"{data}.assignedRobotCode"), F.lit("")).alias("robot"),
        F.when(
            F.col("payload.fromLocationCode").startswith("HAI-"), F.col("payload.fromLocationCode")
        ).alias("source"),
        *[F.when(is_labor(c), c).alias(n) for n, c in labor.items()],
        *[
            parse_epoch_ms(F.col(f"{data}.{field}"), zone or F.col("offset_s")).alias(name)
            for name, field in {
                "created": "wmsTaskCreated",
                "assigned": "assignedTime",
                "loaded": "loadTime",
                "unloaded": "unloadTime",
                "completed": "completedTime",
            }.items()
        ],
    )

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("row_id")))

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("row_id")))

    folded = changes.groupBy("label", "task_code").agg(
        F.min_by("op_day", "row_id").alias("op_day"),
        F.min("row_id").alias("row_id"),
        F.min_by("task_group", "row_id").alias("task_group"),
        _text(last("container")).alias("container_id"),
        _text(last("robot")).alias("robot_id"),
        _text(first("source")).alias("source_loc"),
        F.coalesce(last("final"), first("next")).alias("dest_loc"),
        *[
            last(n).alias(f"{n}_ts")
            for n in ("created", "assigned", "loaded", "unloaded", "completed")
        ],
    )
    done = folded.where(F.col("completed_ts").isNotNull() & F.col("dest_loc").isNotNull())
    return with_durations(done.drop("label"))


def with_durations(tasks: DataFrame) -> DataFrame:
    """Whole seconds, half to even: creation to assignment, and start to completion."""
    begin = F.coalesce("created_ts", "assigned_ts")

    def whole(start: Column, end: Column) -> Column:
        return F.bround(seconds_between(start, end))

    timed = tasks.withColumns(
        {
            "assign_s": whole(F.col("created_ts"), F.col("assigned_ts")),
            "total_s": whole(begin, F.col("completed_ts")),
        }
    )
    # The log has one stage only, so it also stands in for the delivery leg.
    return timed.withColumn("leg_s", F.col("assign_s"))


def log_stages(lifecycle: DataFrame) -> DataFrame:
    """Stage rows of log tasks: the wait for assignment."""
    return lifecycle.select(
        "op_day", "row_id", "task_code", "dest_loc", "completed_ts", "total_s",
        F.lit(ASSIGN_COLUMN).alias("stage"),
        F.lit(S.STAGE_LABELS["分配"]).alias("stage_label"),
        F.lit(1).alias("stage_ord"),
        F.col("assign_s").alias("seconds"),
    )


def load_days(entries: DataFrame) -> DataFrame:
    """Give an undated load one ``op_day``: the date of its first entry.

    Its pairs and tasks then run over midnight as they do in a dated file.
    """
    undated = F.col("label").try_cast("date").isNull()
    first = settle(entries.where(undated).groupBy("label").agg(F.min("op_day").alias("_day")))
    whole = entries.join(first, "label", "left").withColumn("op_day", F.coalesce("_day", "op_day"))
    return whole.select(*entries.columns)


def log_tables(
    entries: DataFrame, overrides: DataFrame | None = None, zone: str | None = None
) -> Tables:
    """All canonical tables of a log. Store them first if many results are wanted."""
    entries = load_days(entries)
    lifecycle = build_lifecycle(entries, zone)
    return Tables(
        build_station_event(entries), build_callback(entries), lifecycle, log_stages(lifecycle),
        overrides,
    )


def _folded_once(t: Tables) -> Tables:
    """The tasks are folded once, for their own table and for the stages."""
    tasks = written(t.lifecycle)
    return replace(t, lifecycle=tasks, stage=log_stages(tasks))


def ingest_log(
    spark: SparkSession, paths: str | Sequence[str], folder: str, overrides: DataFrame | None = None,
    zone: str | None = None, multiline: bool = True, whole: bool = False,
) -> Tables:
    """Parse a log once, write its canonical tables to ``folder`` and read them from there.

    The parsed entries stay in ``folder/entries``; with ``whole`` they keep every field of
    their payloads. Raises if the log holds no readable entry.
    """
    entries = read_event_log(spark, paths, multiline, whole)
    parsed = f"{folder}/entries"
    entries.write.parquet(parsed)
    kept = require_entries(spark.read.parquet(parsed))
    write_raw(_folded_once(log_tables(kept, zone=zone)), folder, by_day=False)
    return read_canonical(spark, folder, overrides)


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, length, modified, load`` of log files: their listing, not their text."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(paths).select(
        "path", "length", F.col("modificationTime").alias("modified"), _load_of(name).alias("load")
    )


def _load_of(file_name: Column) -> Column:
    return F.coalesce(file_date(file_name).cast("string"), file_name)


def ingest_new(
    spark: SparkSession, paths: str | Sequence[str], folder: str, overrides: DataFrame | None = None,
    zone: str | None = None, multiline: bool = True,
) -> Tables:
    """Add to ``folder`` what the log files hold that is not in it yet.

    A manifest names the files (path, length, time) of every load: a day of dated files, or
    an undated file. Loads with a new or changed file are parsed anew, with all their
    files, and replace their own part of each table; other loads are not read. The
    manifest is written last, so an ingest that broke off is repeated. Files that went
    away change nothing, and a table that a changed load no longer fills keeps its old rows.
    """
    files = list_files(spark, paths)
    fresh = files
    known = read_stored(spark, f"{folder}/{MANIFEST}")
    if known is not None:
        fresh = files.join(known.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
    todo = cut_files(files.join(fresh.select("load").distinct(), "load", "left_semi"))
    wanted = [row["path"] for row in todo.select("path").toLocalIterator()]
    if wanted:
        # The entries are parsed once and read by all builders.
        entries = require_entries(written(read_event_log(spark, wanted, multiline)))
        t = _folded_once(log_tables(entries, zone=zone))
        for name, out in S.RAW_NAMES.items():
            _replace_loads(getattr(t, name).withColumn("load", _load_of(F.col("row_id.file"))), f"{folder}/{out}")
        _replace_loads(todo, f"{folder}/{MANIFEST}")
    return read_canonical(spark, folder, overrides)


def cut_files(files: DataFrame) -> DataFrame:
    """The chosen files as listed now, though more may arrive meanwhile."""
    return written(files.select("path", "length", "modified", "load"))


def _replace_loads(df: DataFrame, path: str) -> None:
    """Write a table with a folder per load; only the loads it holds are replaced."""
    df.hint("rebalance", "load").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "load"
    ).parquet(path)


def log_days(entries: DataFrame) -> DataFrame:
    """Files that make up each day: ``label, files``."""
    return entries.groupBy("label").agg(F.count_distinct("row_id.file").alias("files"))
