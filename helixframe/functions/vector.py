"""Arithmetic on array columns and a few special functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def fold_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return fold_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def same_width(a: Column, b: Column, value: Column) -> Column:
    """``value``, but a row whose two vectors differ in width fails the job."""
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vectors differ in width")).cast("double")
    )


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return same_width(a, b, F.sqrt(fold_sum(squares)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NaN where either vector has length zero."""
    scale = norm(a) * norm(b)
    return same_width(a, b, F.when(scale == 0.0, F.lit(float("nan"))).otherwise(dot(a, b) / scale))


def argmax(scores: Column) -> Column:
    """0-based place of the first maximum. NaN counts as the largest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def choose_two(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1.0) / 2.0


_EXACT_UP_TO = 20


def log_factorial(n: Column) -> Column:
    """Natural log of n!: a short exact table, then Stirling's series.

    Beyond 20 the first dropped series term is below 1e-13.
    """
    small = F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(_EXACT_UP_TO + 1)])
    x = n.cast("double")
    inv = 1.0 / x
    inv2 = inv * inv
    series = inv * (1.0 / 12.0 - inv2 * (1.0 / 360.0 - inv2 * (1.0 / 1260.0 - inv2 / 1680.0)))
    stirling = x * F.log(x) - x + 0.5 * F.log(2.0 * math.pi * x) + series
    return F.when(n <= _EXACT_UP_TO, F.get(small, n.cast("int"))).otherwise(stirling)
