"""Bounded samples by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def smallest(rows: DataFrame, place: str, limit: int) -> DataFrame:
    """The rows with the `limit` smallest 64-bit hashes in column `place`; of rows with one hash, one.

    Hashes of different rows are spread evenly, so few of them lie below limit / (their number) of all numbers. Rows above
    twice that are left out before each partition sends its best ones, so that the driver gets some 2 * limit rows, however
    many partitions there are and however often a row is repeated.
    """
    count = rows.agg(F.approx_count_distinct(place)).first()[0]
    if count > 2 * limit:
        rows = rows.filter(F.col(place) < -(1 << 63) + (1 << 64) * 2 * limit // count)
    return rows.dropDuplicates([place]).orderBy(place).limit(limit)
