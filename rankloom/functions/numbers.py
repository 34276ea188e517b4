"""Numeric column functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores that an arg-max or a rank compares keep this many decimals, so that the order in which a distributed sum
#: adds its parts cannot decide a tie.
DECIMALS = 9
#: A little over a half: a value that is a half in decimals goes up, whatever its binary form.
HALF = 0.5001


def stable(x: Column) -> Column:
    return F.floor(x * 1e9 + HALF) / 1e9


def stable_np(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e9 + HALF) / 1e9


def shown(x: Column) -> Column:
    """Six decimals of a value that has nine; a half goes up whatever its binary form."""
    return F.floor(x * 1e6 + HALF) / 1e6


def half_up(x: Column, places: int) -> Column:
    """Rounding that takes a half upwards, below zero too."""
    p = 10**places
    return F.floor(x * p + 0.5) / p


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (1 + F.exp(-x))


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    """0 where the deviation is null or next to nothing."""
    return F.when(F.coalesce(sd, F.lit(0.0)) < 1e-9, F.lit(0.0)).otherwise((x - mean) / sd)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; 0 if one is null or their lengths differ."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(total)


def quantile(sorted_values: Column, q: float) -> Column:
    """The element at floor(n * q) of a sorted array."""
    n = F.size(sorted_values)
    at = F.least(F.floor(n * F.lit(q)).cast("int"), n - 1)
    return F.when(n > 0, F.element_at(sorted_values, at + 1))
