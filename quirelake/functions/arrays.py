"""Expressions on score arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(a: Column) -> Column:
    """Index from 0 of the first maximum; null for an empty or null array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(a: Column) -> Column:
    """Shifted by the maximum, so large scores don't overflow."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def top_probability(a: Column) -> Column:
    """The largest softmax probability, without the others."""
    return F.lit(1.0) / F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(a)))


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))
