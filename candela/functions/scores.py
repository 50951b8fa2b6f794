"""Weights and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candela.schema import TF_LAMBDA, TF_WEIGHT, by_tf


def finite(x: Column) -> Column:
    """Spark orders NaN above all numbers and equal to itself, so it is asked for by name."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def decay_weight(bar_idx: Column, n_bars: Column) -> Column:
    share = F.least(F.greatest(bar_idx / F.greatest(n_bars - 1, F.lit(1)), F.lit(0.0)), F.lit(1.0))
    return F.when(n_bars <= 1, 1.0).otherwise(0.35 + 0.65 * share)


def structural_score(strength: Column, n_tf: Column, tf: Column, age: Column, total: Column) -> Column:
    share = F.greatest(age, F.lit(0)) / F.greatest(total, F.lit(1))
    return strength * by_tf(TF_WEIGHT, 1.0, tf) * n_tf * F.exp(-by_tf(TF_LAMBDA, 1.5, tf) * share)


def quantised(x: Column, steps: float = 1e6) -> Column:
    """Rounded half up on the binary value, by the same steps in any engine."""
    return F.floor(x * steps + 0.5) / steps


def half_even(x: Column, digits: int) -> Column:
    """Rounded to the digits by the double's exact binary value, ties to the even digit.

    The shortest text of 2.675 looks like a tie, its binary value isn't one. x
    is split in two halves of at most 27 bits, whose products with a small
    whole number are exact; so are their distances from the middle between two
    multiples.
    """
    scale = 2.0 * 10**digits
    far = x * 134217729.0
    head = far - (far - x)
    k = F.rint(x * 10.0**digits)
    beyond = lambda middle: (head * scale - middle) + (x - head) * scale
    above, below, odd = beyond(2 * k + 1), beyond(2 * k - 1), F.pmod(k, F.lit(2.0)) == 1.0
    up, down = (above > 0) | ((above == 0) & odd), (below < 0) | ((below == 0) & odd)
    return F.when(up, k + 1).when(down, k - 1).otherwise(k) / 10.0**digits
