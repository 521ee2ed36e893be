"""Predicates and parsers on location, robot and task codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Codes of the source systems.
LABOR_PREFIX = "LABOR"
LABOR_POINT = r"^(?=.*LABOR)(?=.*POINT)[^:]*:[^:]*:\s*[+-]?\d+\s*:\s*[+-]?\d+\s*(:|$)"
STORAGE_LOCATION = r"^HAI[^_-]*-[^_-]*-[^_-]*-"
SHUTTLE_LOCATION = "haiflex"
SHUTTLE_TYPE = "A42"
DELIVERY_TYPE = "K50"
# ---------------------------------------------------------------------------


def is_labor(code: Column) -> Column:
    return code.startswith(LABOR_PREFIX)


def robot_type_of(location: Column) -> Column:
    """Shuttle locations name their fleet; every other robot delivers."""
    shuttle = F.lower(location).contains(SHUTTLE_LOCATION)
    return F.when(shuttle, SHUTTLE_TYPE).otherwise(DELIVERY_TYPE)


def is_storage_location(code: Column) -> Column:
    """``HAI-aisle-bay-level...`` before any ``_suffix``; one look at the code."""
    return code.rlike(STORAGE_LOCATION)


def storage_part(code: Column, position: int) -> Column:
    """Part of a storage location: 2 is the aisle, 3 the bay, 4 the level."""
    return F.split_part(F.substring_index(code, "_", 1), F.lit("-"), F.lit(position))


def is_labor_point(code: Column) -> Column:
    """``<prefix>LABOR:POINT:x:y`` with whole numbers; one look at the code."""
    return code.rlike(LABOR_POINT)


def point_coordinate(code: Column, position: int) -> Column:
    return F.trim(F.try_element_at(F.split(code, ":"), F.lit(position))).try_cast("bigint")
