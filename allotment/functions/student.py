"""Critical values of Student's t for any degrees of freedom and any number of simultaneous intervals."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0: half the regularised incomplete beta function of (df/2, 1/2) at df/(df + t*t)."""
    a, b, x, y = df / 2, 0.5, df / (df + t * t), t * t / (df + t * t)
    if t == 0:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(y))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a / 2
    return (1 - front * _fraction(b, a, y) / b) / 2


def _fraction(a: float, b: float, x: float) -> float:
    """1/(1 + c1/(1 + c2/(1 + ...))) of the incomplete beta function; convergents of the denominator, scaled to above/1."""
    above, below, last_above, last_below, value = 1.0, 1.0, 1.0, 0.0, 1.0
    for m in range(1, 10_000):
        k = m // 2
        c = k * (b - k) * x / ((a + m - 1) * (a + m)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + m - 1) * (a + m))
        above, last_above = above + c * last_above, above
        below, last_below = below + c * last_below, below
        above, last_above, below, last_below = above / below, last_above / below, 1.0, last_below / below
        if abs(above - value) <= 1e-15 * abs(above):
            break
        value = above
    return 1 / above


@lru_cache(maxsize=100_000)
def critical(df: int, tail: float) -> float:
    """t with P(T > t) = tail, by halving an interval that holds it; tail is at most one half."""
    high = 1.0
    while upper_tail(high, df) > tail:
        high *= 2
    low = 0.0
    while (middle := (low + high) / 2) not in (low, high):
        low, high = (middle, high) if upper_tail(middle, df) > tail else (low, middle)
    return high


def simultaneous_t(draws: Column, intervals: Column, alpha: float) -> Column:
    """Bonferroni's critical value: two-sided level alpha over all intervals together, with draws - 1 degrees of freedom.

    Null with fewer than two draws or no interval. Each pair (draws, intervals) is solved once in a batch.
    """
    @F.pandas_udf("double")
    def solve(draws: pd.Series, intervals: pd.Series) -> pd.Series:
        keys = pd.DataFrame({"draws": draws, "intervals": intervals})
        group = keys.groupby(["draws", "intervals"], sort=False).ngroup()
        first = keys[~keys.duplicated()]
        values = [critical(int(d) - 1, alpha / (2 * int(k))) if d > 1 and k > 0 else np.nan for d, k in first.itertuples(index=False)]
        return pd.Series(values, dtype="float64").iloc[group.to_numpy()].reset_index(drop=True)

    known = [F.coalesce(c.cast("bigint"), F.lit(0)) for c in (draws, intervals)]
    return F.nanvl(solve(*known), F.lit(None).cast("double"))
