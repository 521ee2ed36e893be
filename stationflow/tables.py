"""The canonical tables a plan works on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame

from stationflow import schemas as S
from stationflow.operators.stations import (
    build_station_dim,
    completions,
    detect_robot_type,
    of_type,
    with_delivers,
    with_station,
)
from stationflow.session import settle, written


@dataclass(frozen=True)
class Tables:
    """Canonical DataFrames, the station dimension and the delivery robot type.

    The dimension and the robot type are derived from the station events when a
    result first asks for them, and then kept. So are subresults that several parts of
    a result, or several results, read: each is written once to the shared folder.
    """

    station_event: DataFrame | None = None
    callback: DataFrame | None = None
    lifecycle: DataFrame | None = None
    stage: DataFrame | None = None
    overrides: DataFrame | None = None
    names: DataFrame | None = None
    given_type: str | None = None
    per_day: bool = False

    @cached_property
    def settings(self) -> DataFrame | None:
        """The user settings, worked out once."""
        return None if self.overrides is None else settle(self.overrides)

    @cached_property
    def stations(self) -> DataFrame:
        """Station numbers are global over all days; ``per_day`` numbers each day anew."""
        return settle(
            build_station_dim(self.station_event, self.settings, self.names, self.per_day)
        )

    @cached_property
    def robot_type(self) -> str | None:
        """The given type, else that of the user settings, else the detected one."""
        if self.given_type is not None:
            return self.given_type
        if self.settings is not None:
            chosen = self.settings.where("kind = 'robot_type'").select("value").first()
            if chosen is not None:
                return chosen["value"]
        return detect_robot_type(self.station_event).first()["robot_type"]

    @cached_property
    def day_types(self) -> DataFrame | str | None:
        """The delivery type of each ``op_day``: a type that is given or set holds for all days."""
        if self.given_type is not None:
            return self.given_type
        if self.settings is not None:
            chosen = self.settings.where("kind = 'robot_type'").select("value").first()
            if chosen is not None:
                return chosen["value"]
        return settle(detect_robot_type(self.station_event, ["op_day"]))

    @cached_property
    def _subresults(self) -> dict[str, DataFrame]:
        return {}

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The subresult of this name, built and written when it is first asked for."""
        if name not in self._subresults:
            self._subresults[name] = written(build())
        return self._subresults[name]

    def found(self, name: str) -> DataFrame | None:
        """The subresult of this name, if it has been written."""
        return self._subresults.get(name)

    def share_events(self) -> DataFrame:
        """Located station events with ``delivers``; from now on all results start from them."""
        # The shared table is not stored by blocks any more.
        rows = with_delivers(self.station_event.drop(S.TS_BLOCK), self.day_types)
        return self.kept("events", lambda: with_station(rows, self.stations))

    def events(self) -> DataFrame:
        """Station events of all robots: the shared ones if they are there."""
        return self._subresults.get("events", self.station_event)

    def located(self) -> DataFrame:
        """Station events of all robots, with ``station``."""
        shared = self._subresults.get("events")
        return with_station(self.station_event, self.stations) if shared is None else shared.drop("delivers")

    def delivery(self) -> DataFrame:
        """Station events of the delivery robots, with ``station``."""
        shared = self._subresults.get("events")
        if shared is not None:
            return shared.where("delivers").drop("delivers")
        return with_station(of_type(self.station_event, self.day_types), self.stations)

    def completions(self) -> DataFrame:
        return completions(self.delivery())

    def day_stations(self) -> DataFrame:
        """``op_day, station``: the stations with any event that day."""
        shared = self._subresults.get("events")
        if shared is not None:
            return shared.where("station IS NOT NULL").select("op_day", "station").distinct()
        seen = self.station_event.select("op_day", "location_code").distinct()
        return with_station(seen, self.stations, "inner").select("op_day", "station").distinct()

    def only(self, days: DataFrame) -> Tables:
        """Keep the rows of the given ``op_day`` values in every table."""

        def keep(df: DataFrame | None) -> DataFrame | None:
            return None if df is None else df.join(days, "op_day", "left_semi")

        return replace(
            self,
            station_event=keep(self.station_event),
            callback=keep(self.callback),
            lifecycle=keep(self.lifecycle),
            stage=keep(self.stage),
        )
