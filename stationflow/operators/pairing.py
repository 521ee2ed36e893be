"""Event pairs: an opening event and the event that closes it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.times import seconds_between
from stationflow.operators.ordered import BLOCK_S, previous_row, run_before

ORDER = ("ts", "row_id")


def _of_types(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*types) & F.col("ts").isNotNull())


def pair_events(
    events: DataFrame,
    keys: Sequence[str],
    opener: str,
    closer: str,
    carry: Sequence[str] = (),
    mode: str = "last_open",
    block_s: int = BLOCK_S,
    stored: str | None = None,
) -> DataFrame:
    """Rows ``keys, start_ts, end_ts, seconds, carry...`` per (opener, closer) pair.

    ``last_open``: a later opener replaces an open one. ``first_open``: it is
    ignored. ``carry`` columns come from the opener. A closer with nothing open
    is dropped. ``stored`` names the column of blocks that the events are stored by.
    """
    columns = [*keys, "ts", "row_id", "event_type", *[c for c in carry if c not in keys]]
    rows = _of_types(events, opener, closer).select(*columns, *([stored] if stored else []))
    values = [c for c in columns if c not in keys and c != "row_id"]
    if mode == "first_open":
        # The run of openers before the closer: its first one is the open one.
        paired = run_before(rows, keys, ORDER, "event_type", values, block_s, stored)
    elif mode == "last_open":
        paired = previous_row(rows, keys, ORDER, values, block_s, stored)
    else:
        raise ValueError(f"unknown pairing mode {mode!r}")
    pairs = paired.where((F.col("event_type") == closer) & (F.col("prev.event_type") == opener))
    return pairs.select(
        *keys,
        F.col("prev.ts").alias("start_ts"),
        F.col("ts").alias("end_ts"),
        seconds_between(F.col("prev.ts"), F.col("ts")).alias("seconds"),
        *[F.col(f"prev.{c}").alias(c) for c in carry if c not in keys],
    )


def _by_robot(events: DataFrame, opener: str, closer: str, carry: Sequence[str], mode: str, block_s: int) -> DataFrame:
    """Pairs per robot and day; events stored that way are read where they lie."""
    stored = S.TS_BLOCK if S.TS_BLOCK in events.columns and block_s == BLOCK_S else None
    return pair_events(events, S.ROBOT_DAY, opener, closer, carry, mode, block_s, stored)


def pick_pairs(
    events: DataFrame, carry: Sequence[str] = ("location_code",), block_s: int = BLOCK_S
) -> DataFrame:
    """Per robot: arrived, then triggerGo."""
    return _by_robot(events, S.ARRIVED, S.TRIGGER_GO, carry, "last_open", block_s)


def switch_pairs(events: DataFrame, place: str = "station", block_s: int = BLOCK_S) -> DataFrame:
    """Per station: release, then the next arrival of any robot."""
    return pair_events(events, ["op_day", place], S.RELEASE, S.ARRIVED, block_s=block_s)


def dwell_pairs(
    events: DataFrame, carry: Sequence[str] = ("robot_type",), block_s: int = BLOCK_S
) -> DataFrame:
    """Per robot: first open arrival until release."""
    return _by_robot(events, S.ARRIVED, S.RELEASE, carry, "first_open", block_s)
