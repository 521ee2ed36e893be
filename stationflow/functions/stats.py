"""Guarded aggregate expressions: undefined statistics are NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corr(x: Column, y: Column) -> Column:
    """Pearson r; NULL when either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), spread)


def slope(x: Column, y: Column) -> Column:
    return F.regr_slope(y, x)


def intercept(x: Column, y: Column) -> Column:
    return F.regr_intercept(y, x)


def r_squared(x: Column, y: Column) -> Column:
    """R² of y on x; NULL when x or y is constant."""
    varies = (F.var_pop(y) > 0) & (F.var_pop(x) > 0)
    return F.when(varies, F.regr_r2(y, x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    inf = F.lit(float("inf"))
    return F.when(F.isnan(value) | (F.abs(value) == inf), None).otherwise(value)
