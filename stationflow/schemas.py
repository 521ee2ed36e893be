"""Canonical schemas, event names, bounds and source column names."""

from __future__ import annotations

from pyspark.sql import types as T

_TS = T.TimestampNTZType()
_S = T.StringType()
_D = T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


CALLBACK = _struct(
    ("op_day", T.DateType()), ("row_id", T.LongType()), ("ts", _TS), ("action", _S),
    ("task_group", _S), ("task_code", _S), ("robot_id", _S), ("container_id", _S),
    ("location_code", _S), ("location_type", _S), ("callback_id", _S), ("robot_type", _S),
)
STATION_EVENT = _struct(
    ("op_day", T.DateType()), ("row_id", T.LongType()), ("ts", _TS), ("event_type", _S),
    ("location_code", _S), ("robot_id", _S), ("robot_type", _S),
)
LIFECYCLE = _struct(
    ("op_day", T.DateType()), ("row_id", T.LongType()), ("task_code", _S), ("task_group", _S),
    ("container_id", _S), ("robot_id", _S), ("source_loc", _S), ("dest_loc", _S),
    ("created_ts", _TS), ("assigned_ts", _TS), ("loaded_ts", _TS), ("unloaded_ts", _TS),
    ("completed_ts", _TS), ("total_s", _D), ("leg_s", _D), ("shuttle_s", _D),
)
LIFECYCLE_STAGE = _struct(
    ("op_day", T.DateType()), ("row_id", T.LongType()), ("task_code", _S), ("dest_loc", _S),
    ("completed_ts", _TS), ("total_s", _D), ("stage", _S), ("stage_label", _S),
    ("stage_ord", T.IntegerType()), ("seconds", _D),
)

# ---------------------------------------------------------------------------
# These must equal what the source systems write.

ARRIVED = "arrived"
TRIGGER_GO = "triggerGo"
RELEASE = "release"
COMPLETE = "complete"

# Source column -> canonical column, per table.
CALLBACK_COLUMNS = {
    "时间戳": "ts",
    "动作类型": "action",
    "任务组编号": "task_group",
    "任务编号": "task_code",
    "机器人编号": "robot_id",
    "容器编号": "container_id",
    "位置编号": "location_code",
    "位置类型": "location_type",
    "回调ID": "callback_id",
    "机器人类型": "robot_type",
}
STATION_COLUMNS = {
    "时间戳": "ts",
    "事件类型": "event_type",
    "位置编号": "location_code",
    "机器人编号": "robot_id",
    "机器人类型": "robot_type",
}
LIFECYCLE_COLUMNS = {
    "任务编号": "task_code",
    "任务组编号": "task_group",
    "容器编号": "container_id",
    "机器人编号": "robot_id",
    "起始位置": "source_loc",
    "目标位置": "dest_loc",
    "创建时间": "created_ts",
    "分配时间": "assigned_ts",
    "取箱时间": "loaded_ts",
    "放箱时间": "unloaded_ts",
    "complete(任务完成时间)": "completed_ts",
    "任务全程耗时(秒)": "total_s",
}
TOTAL_COLUMN = "任务全程耗时(秒)"
DURATION_MARK = "耗时"
STAGE_SUFFIX = "耗时(秒)"
LEG_MARK = "完成耗时"
K50_LEG_COLUMN = "K50完成耗时(秒)"
SHUTTLE_MARK = "A42"
TIME_MARKS = ("时间戳", "时间")
FALLBACK_NAMES = {
    "callback": "回调明细",
    "station": "labor_station_record",
    "lifecycle": "任务生命周期",
}
REQUIRED_COLUMNS = {
    "callback": ["动作类型", "位置类型"],
    "station": ["事件类型"],
    "lifecycle": [],
}
EXPECTED_COLUMNS = {
    "callback": ["时间戳", "机器人编号", "位置编号", "容器编号"],
    "station": ["时间戳", "机器人编号", "位置编号", "机器人类型"],
    "lifecycle": ["任务全程耗时(秒)", "目标位置", "起始位置", "容器编号"],
}
STAGE_LABELS = {
    "分配": "Allocation wait",
    "A42取箱": "A42 retrieve",
    "A42放箱": "A42 deposit",
    "K50完成": "K50 deliver + dwell",
    "拣选": "Picking",
}
DELIVERY_HINT = "50"
DEFAULT_DELIVERY_TYPE = "K50"
OVERRIDE_KEYS = ["station_types", "design_rates", "type_colors", "amr_type"]

# Bounds in seconds; they differ between results on purpose.
PICK_MAX_S = 3600.0
SWITCH_MAX_S = 7200.0
CYCLE_MAX_S = 7200.0
STAGE_MAX_S = 3600.0
LEG_DEPTH_MAX_S = 3600.0
LEG_UTIL_MAX_S = 7200.0
FIXED_SWITCH_S = 6.0
HOUR_S = 3600.0
# ---------------------------------------------------------------------------

# Folder of each canonical table.
# Events stored for pairing lie together by robot, day and this column: the block of their time.
ROBOT_DAY = ("op_day", "robot_id")
TS_BLOCK = "ts_block"
RAW_NAMES = {"callback": "cb_raw", "station_event": "st_raw", "lifecycle": "lc_raw", "stage": "sg_raw"}
