"""Player tables: number the participants of every game 0..n-1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allotment.operators.skew import Split, attach, range_bucket, rank_rows, split_games


def number_players(raw: DataFrame, order: list[str], totals: dict | None = None) -> Split:
    """Add `player` (0-based, in the given order) and `n` to rows keyed by game_id.

    The first order column must be numeric. `totals` adds game-level aggregates.
    """
    totals = totals or {}

    def step(df: DataFrame, hot: bool) -> DataFrame:
        if hot:
            df = (attach(df, ["game_id"], hot, **totals) if totals else df).withColumn("n", F.col("game_rows"))
        else:
            df = attach(df, ["game_id"], hot, n=F.count(F.lit(1)), **totals)
        df = df.withColumn("n", F.col("n").cast("int"))
        size = F.col("n")
        bucket = range_bucket(order[0], size) if hot else F.lit(0)
        ranked = rank_rows(df, ["game_id"], order, bucket, "_rank", hot)
        return ranked.withColumn("player", F.col("_rank") - 1).drop("_rank", "game_rows", "lead_low", "lead_high")

    return split_games(raw, order[0]).map(step)
