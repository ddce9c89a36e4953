"""Randomness keyed by content.

Every draw is a hash of (seed, game, sample, player), never of a partition, so a
result is the same for any number of tasks and after any retry, and plain SQL can
reproduce it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_SPAN = float(16**15)


def _digest(parts) -> Column:
    cols = [F.lit(p) if isinstance(p, (str, int)) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def order_key(*parts) -> Column:
    """A 60-bit integer to sort by: a uniformly random order of the rows."""
    return F.conv(F.substring(_digest(parts), 1, 15), 16, 10).cast("bigint")


def order_keys(parts: list[tuple], n: int) -> np.ndarray:
    """`order_key(*parts, p)` of p = 0..n-1 for tuples of parts, a row each, outside of Spark; None is skipped as there."""
    md5, tails = hashlib.md5, [b"|%d" % p for p in range(n)]
    heads = ["|".join([str(x) for x in own if x is not None]).encode() for own in parts]
    digests = b"".join([md5(head + tail).digest()[:8] for head in heads for tail in tails])
    return (np.frombuffer(digests, ">u8").reshape(len(heads), n) >> 4).astype(np.int64)


def first_in_order(parts: list[tuple], n: np.ndarray, size: np.ndarray, leave_out: np.ndarray | None = None) -> pa.ListArray:
    """The first `size` of 0..n-1 by `order_keys` for every tuple of parts, without the number to leave out."""
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], dtype=np.int32)
    for players in np.unique(n).tolist():
        rows = np.flatnonzero(n == players)
        keys = order_keys([parts[r] for r in rows.tolist()], players)
        if leave_out is not None:
            keys[np.arange(len(rows)), leave_out[rows]] = np.iinfo(np.int64).max
        order = np.argsort(keys, axis=1, kind="stable")
        take = np.arange(players) < size[rows, None]
        out[(ends[rows, None] + np.arange(players))[take]] = order[take]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))


def uniform(*parts) -> Column:
    """A uniform number in [0, 1) with 32 bits."""
    return F.conv(F.substring(_digest(parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tidy(value: Column, places: int = 4) -> Column:
    """Round for reports.

    The small shift keeps exact half-way values off the rounding edge, where the
    last bit of a floating-point sum would decide.
    """
    return F.round(value + F.lit(3.7e-8), places) + F.lit(0.0)
