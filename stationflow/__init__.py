"""Warehouse-flow analytics as PySpark DataFrame programs.

Sources turn event logs or tables into canonical DataFrames, operators pair,
slice, overlap and rank them, and plans combine operators into named results.
Every result is a lazy, tidy DataFrame keyed by ``op_day``.
"""

from stationflow.session import get_session
from stationflow.tables import Tables

__all__ = ["Tables", "get_session"]
