"""The given tables seen as warehouse tables (the same mapping is in ``oracle``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.session import prepare
from stationflow.tables import Tables

# Source column, label and factor on ``value``, in stage order.
STAGES = [
    ("分配耗时(秒)", "Allocation wait", 0.5),
    ("A42取箱耗时(秒)", "A42 retrieve", 2.0),
    ("A42放箱耗时(秒)", "A42 deposit", 1.0),
    ("K50完成耗时(秒)", "K50 deliver + dwell", 10.0),
]
SETTINGS = (
    '{"station_types": {"LABOR-3": "Zone X"},'
    ' "design_rates": {"LABOR-1": 4, "Zone A": 6, "Zone B": 5}, "amr_type": "K50"}'
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .withColumn("k", k)
        .withColumn("op_day", F.to_date("ts"))
    )


def labor_point(k):
    """Six points, three in each of two rows."""
    spots = [f"LT_LABOR:POINT:{i % 3}:{0 if i < 3 else 1}" for i in range(6)]
    return F.element_at(F.array(*map(F.lit, spots)), k % 6 + 1)


def destination():
    return F.when(F.col("k") % 11 == 0, "PORT-1").otherwise(
        F.concat(F.lit("LABOR-"), F.col("k") % 6 + 1)
    )


def storage():
    spot = F.concat(
        F.lit("HAI-"), F.col("k") % 20, F.lit("-"), F.col("user_id") % 30 + 1, F.lit("-1-1")
    )
    return F.when(F.col("k") % 10 == 0, "BUF-1").otherwise(spot)


def station_event(ev: DataFrame) -> DataFrame:
    names = {"click": "arrived", "purchase": "triggerGo", "view": "release", "signup": "ppReady"}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    kind = F.coalesce(F.try_element_at(known, F.col("event_type")), F.lit("other"))
    return ev.select(
        "op_day",
        F.col("event_id").alias("row_id"),
        "ts",
        kind.alias("event_type"),
        labor_point(F.col("k")).alias("location_code"),
        F.concat(F.lit("R"), F.col("user_id") % 4).alias("robot_id"),
        F.when(F.col("user_id") % 4 == 3, "A42").otherwise("K50").alias("robot_type"),
    )


def callback(ev: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return ev.select(
        "op_day",
        F.col("event_id").alias("row_id"),
        "ts",
        F.when(kind == "purchase", "complete").when(kind == "click", "load").otherwise("unload").alias(
            "action"
        ),
        destination().alias("location_type"),
        F.concat(F.lit("LOC-"), F.col("k")).alias("location_code"),
    )


def lifecycle(ev: DataFrame) -> DataFrame:
    value = F.col("value")
    return ev.select(
        "op_day",
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("ND"), F.col("event_id")).alias("task_code"),
        F.concat(F.lit("T"), F.col("user_id")).alias("container_id"),
        storage().alias("source_loc"),
        destination().alias("dest_loc"),
        F.col("ts").alias("completed_ts"),
        (value * 40).alias("total_s"),
        (value * 10).alias("leg_s"),
        (value * 3).alias("shuttle_s"),
    )


def stage_rows(ev: DataFrame) -> DataFrame:
    cells = [
        F.struct(
            F.lit(name).alias("stage"),
            F.lit(label).alias("stage_label"),
            F.lit(i).alias("stage_ord"),
            (F.col("value") * factor).alias("seconds"),
        )
        for i, (name, label, factor) in enumerate(STAGES, start=1)
    ]
    return ev.select(
        "op_day",
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("ND"), F.col("event_id")).alias("task_code"),
        destination().alias("dest_loc"),
        F.col("ts").alias("completed_ts"),
        (F.col("value") * 40).alias("total_s"),
        F.inline(F.array(*cells)),
    )


def settings(ev: DataFrame) -> DataFrame:
    """The user settings as one row."""
    return ev.sparkSession.range(1).select(F.lit(SETTINGS).alias("text"))


def tables(spark: SparkSession, sf_dir: str, overrides: DataFrame | None = None) -> Tables:
    ev = events(spark, sf_dir)
    return Tables(station_event(ev), callback(ev), lifecycle(ev), stage_rows(ev), overrides)


def wide_lifecycle(spark: SparkSession, sf_dir: str) -> Tables:
    """Line items as retrievals: many totes, aisles and bays."""
    prepare(spark)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.to_date("l_shipdate").alias("op_day"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.col("l_partkey").cast("string").alias("container_id"),
        F.concat(
            F.lit("HAI-"), F.col("l_suppkey") % 20, F.lit("-"), F.col("l_orderkey") % 30 + 1,
            F.lit("-1-1"),
        ).alias("source_loc"),
    )
    return Tables(lifecycle=rows)


def direct_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pick per event, with ``value`` as its seconds."""
    station = F.concat(F.lit("LABOR-"), F.col("k") % 6 + 1)
    return events(spark, sf_dir).select(station.alias("station"), F.col("value").alias("pick_s"))


def source_lifecycle(ev: DataFrame) -> DataFrame:
    """The lifecycle table as a source system names it, with one empty stage."""
    return ev.select(
        F.concat(F.lit("ND"), F.col("event_id")).alias("任务编号"),
        F.concat(F.lit("T"), F.col("user_id")).alias("容器编号"),
        storage().alias("起始位置"),
        destination().alias("目标位置"),
        F.col("ts").alias("complete(任务完成时间)"),
        (F.col("value") * 40).alias("任务全程耗时(秒)"),
        *[(F.col("value") * factor).alias(name) for name, _, factor in STAGES],
        F.lit(None).cast("double").alias("拣选耗时(秒)"),
    )


def source_station(ev: DataFrame) -> DataFrame:
    """The station table as a source system names it; two thirds of its times are bad."""
    return station_event(ev).select(
        F.when(F.col("row_id") % 3 == 0, F.col("ts").cast("string")).otherwise("n/a").alias("时间戳"),
        F.col("event_type").alias("事件类型"),
        F.col("location_code").alias("位置编号"),
        F.col("robot_type").alias("机器人类型"),
    )


def source_callback(ev: DataFrame) -> DataFrame:
    return callback(ev).select(
        F.col("ts").alias("时间戳"),
        F.col("action").alias("动作类型"),
        F.col("location_type").alias("位置类型"),
        F.col("location_code").alias("位置编号"),
    )


def log_lines(ev: DataFrame) -> DataFrame:
    """Events written as log entries, one file per day.

    Every event gives a callback entry; purchases and views also give a task
    change, and errors a line that is no entry.
    """
    labor = F.concat(F.lit("LABOR-"), F.col("k") % 6 + 1)
    station = destination()
    point = labor_point(F.col("k"))
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", "CALLBACK_OF_ROBOT_REACH_STATION")
        .when(kind == "purchase", "CALLBACK_OF_TASK_FINISHED")
        .when(kind == "view", "CALLBACK_OF_TOTE_LOADED_BY_ROBOT")
        .otherwise("CALLBACK_OF_TOTE_UNLOADED_BY_ROBOT")
    )
    action = F.when(F.col("k") % 2 == 0, "put")
    robot = F.concat(F.lit("robot-"), F.col("user_id") % 4)
    message = F.to_json(
        F.struct(
            station.alias("stationCode"), point.alias("locationCode"), robot.alias("robotCode"),
            action.alias("actionCode"),
        )
    )
    task = F.concat(F.lit("ND"), F.col("user_id"))
    callback_json = F.to_json(
        F.struct(
            F.array(task).alias("taskCode"),
            F.array(F.concat(F.lit("T"), F.col("user_id"))).alias("containerCode"),
            F.struct(
                name.alias("name"), message.alias("message"), F.col("event_id").alias("id")
            ).alias("data"),
        )
    )
    # Epoch times are absolute, and the clock of the log is eight hours ahead.
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - 8 * 3_600_000
    change_json = F.to_json(
        F.struct(
            F.array(task).alias("taskCode"),
            F.concat(F.lit("G"), F.col("k")).alias("taskGroupCode"),
            F.when(F.col("k") % 3 == 0, F.concat(F.lit("HAI-"), F.col("k"), F.lit("-1-1-1"))).alias(
                "fromLocationCode"
            ),
            F.struct(
                robot.alias("assignedRobotCode"),
                F.when(kind == "purchase", station).alias("finalToStationCode"),
                F.array(labor).alias("nextDestination"),
                F.when(kind == "view", (ms - 1500).cast("string")).otherwise("0").alias("assignedTime"),
                F.when(kind == "purchase", ms).otherwise(F.lit(0)).alias("completedTime"),
            ).alias("data"),
            # Read by no table: a list of objects, and a field of two types.
            F.array(
                F.struct((F.col("k") % 7).alias("hop")), F.struct((F.col("k") % 5).alias("hop"))
            ).alias("route"),
            F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise("low").alias("battery"),
        )
    )
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+08:00"))

    def entry(event: str, payload):
        return F.concat(
            F.lit("["), stamp, F.lit(f"][1][app][env][Cat][{event}] - "), payload
        )

    entries = F.array_compact(
        F.array(
            entry("TASK_EXECUTION_CALLBACK_SENT", callback_json),
            F.when(
                kind.isin("purchase", "view"), entry("BUSINESS_TASK_DATA_CHANGE", change_json)
            ),
            F.when(kind == "error", F.lit("java.lang.Error: broken {")),
        )
    )
    return ev.select(
        F.posexplode(entries).alias("_pos", "value"),
        F.concat(F.lit("flow-"), F.col("op_day").cast("string"), F.lit(".log")).alias("file_name"),
        F.lit(0).cast("bigint").alias("block"),
        (F.col("event_id") * 4).alias("_base"),
    ).select("value", "file_name", "block", (F.col("_base") + F.col("_pos")).alias("line"))
