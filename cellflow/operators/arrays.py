"""Functions of array columns (waveforms): moving mean, peak, centre of gravity, threshold crossing. Higher-order functions, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double"))


def moving_mean(a: Column, size: int) -> Column:
    """Mean over a centred window, shorter at the ends."""
    half = size // 2
    piece = lambda i: F.slice(a, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, F.size(a) - 1) - F.greatest(i - half, F.lit(0)) + 1)
    return F.transform(a, lambda x, i: total(piece(i)) / F.size(piece(i)))


def peak(a: Column) -> Column:
    """Position (from 0) of the first largest value."""
    return F.array_position(a, F.array_max(a)) - 1


def centre_of_gravity(a: Column) -> Column:
    """Centre of the squared values."""
    sq = F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    return F.aggregate(F.transform(sq, lambda x, i: x * i), F.lit(0.0), lambda x, y: x + y) / total(sq)


def first_over(a: Column, share: float) -> Column:
    """The first position whose value is over a share of the largest; null if none."""
    hits = F.filter(F.transform(a, lambda x, i: F.when(x > share * F.array_max(a), i)), lambda x: x.isNotNull())
    return F.get(hits, 0)
