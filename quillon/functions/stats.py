"""Aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

stdev, stdevp, var, varp = F.stddev_samp, F.stddev_pop, F.var_samp, F.var_pop
low, high = F.min, F.max


def total(x: Column, kind: str | None = None) -> Column:
    """A sum that is 0 over no rows."""
    s = F.coalesce(F.sum(x), F.lit(0))
    return s.cast(kind) if kind else s


def average(x: Column) -> Column:
    return F.avg(x.cast("double"))


def count() -> Column:
    return F.count(F.lit(1))


def count_if(p: Column) -> Column:
    return F.count(F.when(p, 1))


def sum_bool(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("int")), F.lit(0))
