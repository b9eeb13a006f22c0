"""Numeric functions, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def or_else(x: Column, default: float) -> Column:
    """The value, or the default where it is null, zero or not a number: a falsy value counts as missing."""
    value = x.cast("double")
    return F.when(value.isNull() | F.isnan(value) | (value == 0), F.lit(float(default))).otherwise(value)


def saturation(x: Column, top: float = 60.0) -> Column:
    return F.log1p(x) / math.log1p(top)


def gaussian(x: Column, center: float, width: float) -> Column:
    return F.exp(-F.pow(x - center, 2) / (2 * width**2))


def steps(x: Column, bounds: list[tuple[float, float]], otherwise: float) -> Column:
    """The value of the first bound that x doesn't exceed."""
    out = F.when(x <= bounds[0][0], bounds[0][1])
    for bound, value in bounds[1:]:
        out = out.when(x <= bound, value)
    return out.otherwise(otherwise)


def minmax(x: Column, low: Column, high: Column, constant: float = 0.0) -> Column:
    """Scales to 0..1; constant if all values are alike."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(constant))


def zscore(x: Column, mean: Column, deviation: Column) -> Column:
    return (x - mean) / F.when(deviation > 0, deviation).otherwise(1.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def category_depth(counts: list[Column], thresholds: list[float]) -> Column:
    """The mean of capped counts, with a share for how many are deep."""
    parts = [clamp(c / t) for c, t in zip(counts, thresholds)]
    mean = sum(parts[1:], parts[0]) / len(parts)
    deep = sum(((p >= 0.75).cast("int") for p in parts[1:]), (parts[0] >= 0.75).cast("int"))
    return clamp(0.55 * mean + 0.45 * (deep / 3.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def average_rank(order: Column, *partition: str) -> Column:
    """Ranks from 1 where ties share their mean."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(w.partitionBy(*partition, order)) - 1) / 2


def months_between(start: Column, end: Column) -> Column:
    """Months from YYYY-MM to YYYY-MM texts."""
    part = lambda c, a, n: F.substring(c, a, n).try_cast("int")
    return (part(end, 1, 4) - part(start, 1, 4)) * 12 + part(end, 6, 2) - part(start, 6, 2)


def six(x: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(x.cast("double"), 6) + F.lit(0.0)
