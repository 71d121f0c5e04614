"""Vectors of slots: totals, hours, scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(q: Column, scale: float = 1.0) -> Column:
    """The sum of the slots times a scale; nulls are 0, and so is a day without readings."""
    return F.aggregate(q, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))) * F.lit(scale)


def nulls(q: Column) -> Column:
    return F.size(F.filter(q, lambda x: x.isNull()))


def hours(q: Column, per_hour: int = 4) -> Column:
    """24 sums of neighbouring slots; nulls are 0."""
    part = lambda h: F.aggregate(F.slice(q, h * per_hour + 1, per_hour), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.transform(F.sequence(F.lit(0), F.lit(23)), part)


def minmax(q: Column) -> Column:
    """From 0 to 1; a constant vector is 0 throughout, nulls stay."""
    lo, width = F.array_min(q), F.array_max(q) - F.array_min(q)
    return F.transform(q, lambda x: F.when(x.isNotNull(), F.coalesce(F.try_divide(x - lo, width), F.lit(0.0))))


def any_nonzero(q: Column) -> Column:
    return F.exists(q, lambda x: F.coalesce(x, F.lit(0)) != 0)


def log10_positive(v: Column) -> Column:
    return F.when(v > 0, F.log10(v))
