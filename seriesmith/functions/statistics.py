"""Aggregate expressions with the missing-value rules the feature tables need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_slope(value: Column, position: Column, size: Column | int) -> Column:
    """Least-squares slope; NULL as soon as one of the ``size`` values is missing."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.when(F.count(value) == n, F.regr_slope(value, position))


def constant_flag(value: Column) -> Column:
    """1 when at least two values exist and all are equal, else 0."""
    same = (F.count(value) >= 2) & (F.min(value) == F.max(value))
    return F.coalesce(same, F.lit(False)).cast("tinyint")


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL when either side is constant."""
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    varies = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    return F.when(varies, F.try_divide(F.covar_pop(px, py), spread))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
