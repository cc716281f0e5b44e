"""Small Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def least(a: Column, b: Column) -> Column:
    return F.when(a <= b, a).otherwise(b)


def idiv(a: Column, b: Column) -> Column:
    """Whole quotient of positive numbers; null for a divisor of 0."""
    return F.when(b > 0, F.floor(a / b)).cast("long")


def plain(x: Column) -> Column:
    """A number without a trailing .0."""
    whole = x.cast("double") == F.floor(x.cast("double"))
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("double").cast("string"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
