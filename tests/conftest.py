from __future__ import annotations

import sys
from datetime import date, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stationflow import schemas as S  # noqa: E402
from stationflow.session import get_session  # noqa: E402
from stationflow.tables import Tables  # noqa: E402

DAY = date(2026, 6, 25)


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    """``HH:MM:SS[.f]`` on the test day, or a full ISO time."""
    return datetime.fromisoformat(text if "-" in text else f"{DAY}T{text}")


@pytest.fixture(scope="session")
def make_events(spark):
    """Rows (time, event, location number, robot[, type]) -> station events of one op_day."""

    def build(rows, op_day=DAY):
        data = [
            (
                op_day,
                i,
                at(ts) if isinstance(ts, str) else ts,
                event,
                f"LT_LABOR:POINT:{loc}:0" if isinstance(loc, int) else loc,
                robot,
                (rest or ["K50"])[0],
            )
            for i, (ts, event, loc, robot, *rest) in enumerate(rows)
        ]
        return spark.createDataFrame(data, S.STATION_EVENT)

    return build


@pytest.fixture(scope="session")
def make_lifecycle(spark):
    """Dicts of lifecycle columns -> lifecycle rows."""

    def build(rows):
        names = S.LIFECYCLE.fieldNames()
        data = [
            tuple({"op_day": DAY, "row_id": i, **row}.get(n) for n in names)
            for i, row in enumerate(rows)
        ]
        return spark.createDataFrame(data, S.LIFECYCLE)

    return build


@pytest.fixture(scope="session")
def make_callback(spark):
    def build(rows):
        names = S.CALLBACK.fieldNames()
        data = [
            tuple({"op_day": DAY, "row_id": i, **row}.get(n) for n in names)
            for i, row in enumerate(rows)
        ]
        return spark.createDataFrame(data, S.CALLBACK)

    return build


@pytest.fixture(scope="session")
def make_tables(make_events):
    def build(events, **rest):
        return Tables(make_events(events), **rest)

    return build
