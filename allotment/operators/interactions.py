"""Games given by weighted terms: a term pays its weight once all its players are in.

Terms are long: (game_id, term_id, player, weight, degree), one row per member, any degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allotment.operators.skew import large


def terms_of(pairs: DataFrame) -> DataFrame:
    """Complete (game_id, term_id, player, part) rows with the term's weight and degree.

    The weight of a term is the sum of its parts. Totals are joined back rather than windowed,
    so a term with very many rows is aggregated in pieces.
    """
    totals = pairs.groupBy("game_id", "term_id").agg(F.sum("part").alias("weight"), F.count(F.lit(1)).alias("degree"))
    return pairs.select("game_id", "term_id", "player").join(large(totals), ["game_id", "term_id"])


def coalition_values(members: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Value of every coalition in `members` (keys + player): weights of the terms it contains."""
    met = members.select(*keys, "player").join(large(terms), ["game_id", "player"])
    active = met.groupBy(*keys, "term_id").agg(
        F.count(F.lit(1)).alias("met"), F.first("degree").alias("degree"), F.first("weight").alias("weight"))
    paid = active.where("met = degree").groupBy(*keys).agg(F.sum("weight").alias("value"))
    every = members.select(*keys).distinct()
    return every.join(large(paid), keys, "left").withColumn("value", F.coalesce("value", F.lit(0)))


def path_shares(paths: DataFrame, terms: DataFrame, samples: int) -> DataFrame:
    """Permutation estimate: on every path a term pays the last of its players to arrive."""
    arrivals = paths.select("game_id", "sample", "player", "pos").join(large(terms), ["game_id", "player"])
    last = arrivals.groupBy("game_id", "sample", "term_id").agg(
        F.max_by("player", "pos").alias("player"), F.first("weight").alias("weight"))
    paid = last.groupBy("game_id", "player").agg(F.sum("weight").alias("total"))
    return paid.select("game_id", "player", (F.col("total") / samples).alias("share"))


def boundary_values(players: DataFrame, terms: DataFrame) -> DataFrame:
    """e = 0, f = all weights, v({i}) = weights of i's own degree-1 terms, v(N without i) = f - weights with i."""
    per_player = terms.groupBy("game_id", "player").agg(
        F.sum(F.when(F.col("degree") == 1, F.col("weight")).otherwise(0)).alias("single_value"),
        F.sum("weight").alias("_with"))
    each = terms.groupBy("game_id", "term_id").agg(F.first("weight").alias("weight"))
    full = each.groupBy("game_id").agg(F.sum("weight").alias("full_value"))
    joined = players.join(large(per_player), ["game_id", "player"], "left").join(full, "game_id", "left").fillna(0)
    return joined.withColumn("empty_value", F.lit(0.0)).withColumn("without_value", F.col("full_value") - F.col("_with")).drop("_with")
