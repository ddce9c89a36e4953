"""Size laws of the sampling designs, as column expressions over `n`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def harmonic(k: Column) -> Column:
    """H_k = 1 + 1/2 + ... + 1/k, and 0 for k < 1."""
    return F.when(k < 1, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(0.0),
                    lambda acc, i: acc + F.lit(1.0) / i)
    )


def inner_weight(s: Column, n: Column) -> Column:
    """Unnormalised weight of an inner size 2..n-2: 1/sqrt(s(n-s))."""
    return F.lit(1.0) / F.sqrt((s * (n - s)).cast("double"))


def kernel_weight(s: Column, n: Column) -> Column:
    """Unnormalised weight of a proper size 1..n-1: 1/(s(n-s))."""
    return F.lit(1.0) / (s * (n - s)).cast("double")


class SizeLaw:
    """A law over the sizes first..n-last, with inverse-CDF draws."""

    def __init__(self, name, weight, first: int, last: int):
        self.name, self.weight, self.first, self.last = name, weight, first, last

    def sizes(self, n: Column) -> Column:
        low = F.lit(self.first)
        return F.sequence(low, F.greatest(n - F.lit(self.last), low).cast("int"))

    def total(self, n: Column) -> Column:
        return F.aggregate(self.sizes(n), F.lit(0.0), lambda acc, s: acc + self.weight(s, n))

    def draw(self, u: Column, n: Column) -> Column:
        """The first size whose cumulative share exceeds u."""
        # The target rides in the accumulator: an expression inside the step would be recomputed at every size.
        start = F.struct(F.lit(0.0).alias("cum"), F.lit(self.first).alias("size"), (u * self.total(n)).alias("target"))

        def step(acc, s):
            cum = acc["cum"] + self.weight(s, n)
            size = F.when((cum <= acc["target"]) & (s < n - F.lit(self.last)), s + 1).otherwise(acc["size"])
            return F.struct(cum.alias("cum"), size.cast("int").alias("size"), acc["target"].alias("target"))

        return F.aggregate(self.sizes(n), start, step)["size"]


INNER = SizeLaw("inner", inner_weight, 2, 2)
KERNEL = SizeLaw("kernel", kernel_weight, 1, 1)
UNIFORM = SizeLaw("uniform", lambda s, n: F.lit(1.0), 1, 0)


def inner_total(n: Column) -> Column:
    """Z = sum over s=2..n-2 of 1/sqrt(s(n-s))."""
    return INNER.total(n)


def kernel_total(n: Column) -> Column:
    """Z = sum over s=1..n-1 of 1/s + 1/(n-s) = 2 H_(n-1)."""
    return F.lit(2.0) * harmonic(n - 1)
