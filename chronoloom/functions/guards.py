"""Expressions that return null where a plain one would raise or mislead under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null for a constant side."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    cov = F.covar_pop(x, y)
    vx, vy = F.var_pop(F.when(y.isNotNull(), x)), F.var_pop(F.when(x.isNotNull(), y))
    return F.when((n > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def r_squared(y: Column, x: Column) -> Column:
    """Share of variance a line explains; 0 for a constant y."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    cov = F.covar_pop(x, y)
    return F.when((vx > 0) & (vy > 0), cov * cov / (vx * vy)).otherwise(F.lit(0.0))


def slope(y: Column, x: Column) -> Column:
    vx = F.var_pop(x)
    return F.when(vx > 0, F.covar_pop(x, y) / vx)


def intercept(y: Column, x: Column) -> Column:
    return F.avg(y) - slope(y, x) * F.avg(x)
