"""Games of very different sizes in one job.

Most games are small: all rows of a game sit in one partition and plain windows
do the work. A few may hold a large part of all rows. `Split` keeps the two kinds
apart, so that a hot game never meets a window over the whole game; its ranks and
running values are computed in two levels over evenly sized buckets instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allotment.functions.hashing import KEY_SPAN
from allotment.sources.shared import cut

DEFAULT_HOT_ROWS = 1_000_000


def hot_rows() -> int:
    """Rows above which a game is hot (`spark.allotment.hotRows`)."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return int(spark.conf.get("spark.allotment.hotRows", str(DEFAULT_HOT_ROWS)))


@dataclass
class Split:
    """Rows of ordinary games and, if there are any, rows of hot games, with the same meaning."""

    cold: DataFrame
    hot: DataFrame | None = None

    def map(self, step: Callable[[DataFrame, bool], DataFrame]) -> "Split":
        return Split(step(self.cold, False), None if self.hot is None else step(self.hot, True))

    def rows(self) -> DataFrame:
        if self.hot is None:
            return self.cold
        keep = [c for c in self.cold.columns if c in self.hot.columns]
        return self.cold.select(*keep).unionByName(self.hot.select(*keep))


def split_games(raw: DataFrame, lead: str, game: str = "game_id", counted: DataFrame | None = None) -> Split:
    """Look for hot games with one pre-aggregated count (of `counted`, by default `raw` itself).

    This is the one eager job of a query: the shape of the plan depends on its answer.
    The list of hot games has at most rows / hot_rows() entries, whatever the data,
    which is what makes it fit for a broadcast. It is written once, so that both sides
    of the split read the same list.
    """
    stats = (raw if counted is None else counted).groupBy(game).agg(
        F.count(F.lit(1)).alias("game_rows"),
        F.min(lead).cast("double").alias("lead_low"),
        F.max(lead).cast("double").alias("lead_high"),
    ).where(F.col("game_rows") > hot_rows())
    if stats.isEmpty():
        return Split(raw)
    stats = cut(stats)
    cold = raw.join(F.broadcast(stats.select(game)), game, "left_anti")
    hot = raw.join(F.broadcast(stats), game)
    return Split(cold, hot)


def attach(df: DataFrame, keys: list[str], hot: bool, **aggs: Column) -> DataFrame:
    """Add group totals to every row: a window, or for hot groups a pre-aggregate and a join."""
    if not hot:
        w = Window.partitionBy(*keys)
        return df.select("*", *[a.over(w).alias(name) for name, a in aggs.items()])
    df = cut(df)
    totals = df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggs.items()])
    return df.join(totals, keys)


def large(df: DataFrame) -> DataFrame:
    """One side of a join of tables that both grow with the games: sorted and merged, never collected for a broadcast.

    The planner takes a table's size from its files, before `explode` multiplies the rows, and may broadcast millions of
    them. Not for a side with few keys or the totals of hot games, whose rows would meet in one task.
    """
    return df.hint("merge")


def in_a_row(players: DataFrame, *columns: str) -> DataFrame:
    """(game_id, own): the columns of a game's players in one array, at the place of the player's number.

    A design that holds a whole coalition in a row takes them along before it is multiplied, so that only this and the
    design are shuffled. Players are numbered 0..n-1.
    """
    return players.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct("player", *columns))).alias("own"))


def rank_rows(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str, hot: bool) -> DataFrame:
    """1-based rank within keys. Hot groups: rank within a bucket plus the rows of earlier buckets.

    `bucket` must be non-decreasing in the order.
    """
    if not hot:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    split = cut(df.withColumn("_bucket", bucket.cast("bigint")))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        split.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        split.withColumn("_within", F.row_number().over(within))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_within") + F.col("_offset")).cast("int"))
        .drop("_within", "_offset", "_bucket")
    )


def range_bucket(lead: str, size: Column) -> Column:
    """Bucket a hot game by equal ranges of its leading order column."""
    share = (F.col(lead).cast("double") - F.col("lead_low")) / (F.col("lead_high") - F.col("lead_low") + 1.0)
    return F.floor(share * F.ceil(size / F.lit(hot_rows())))


def key_bucket(key: str, size: Column) -> Column:
    """Bucket by a uniform order key: even by construction."""
    return F.floor(F.col(key) / F.lit(KEY_SPAN) * F.ceil(size / F.lit(hot_rows())))
