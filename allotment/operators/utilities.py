"""Utilities of coalitions, as aggregates over the member rows of a coalition.

A utility names what one member brings (`own`), how many members fold into a state
(`fold`, an aggregate that can also fold states) and the value of a state. The same
parts serve grouped evaluation, window evaluation, running evaluation along a
permutation, and the two-level evaluation of hot games.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allotment.operators.skew import Split, attach, cut, hot_rows, key_bucket, large

SAMPLE = ["game_id", "block", "sample"]


@dataclass(frozen=True)
class Utility:
    name: str
    own: Callable[[], Column]
    fold: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    value: Callable[[Column], Column]

    def state(self, inside: Column | None = None) -> Column:
        return self.fold(self.own() if inside is None else F.when(inside, self.own()))

    def of_empty(self) -> Column:
        return self.value(F.when(F.lit(False), self.own()))


@dataclass(frozen=True)
class BatchUtility:
    """A utility that values whole coalitions and can not be folded member by member.

    `call` gets a pandas DataFrame with a coalition per row (`members`, a list of players in ascending order or in order of arrival, and a
    list for each of `columns`, what the members bring) and returns a finite number per row. It may be costly, so nothing
    calls it twice for a row, and truncated paths stop calling it.
    """

    name: str
    call: Callable
    columns: tuple[str, ...] = ()


def _add(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def max_cost(cost: str = "cost") -> Utility:
    """Airport game: a coalition costs as much as its dearest member, nothing when empty."""
    return Utility("max_cost", lambda: F.col(cost), F.max, lambda a, b: F.greatest(a, b),
                   lambda s: F.coalesce(s, F.lit(0)).cast("double"))


def weighted_majority(weight: str = "weight", quota: str = "quota") -> Utility:
    """Voting game: 1 once the members' weight reaches the quota, inclusive."""
    return Utility("weighted_majority", lambda: F.col(weight), F.sum, _add,
                   lambda s: F.when(F.coalesce(s, F.lit(0)) >= F.col(quota), 1.0).otherwise(0.0))


def additive(coef: str = "coef", constant: float = 0.0) -> Utility:
    """Affine game: constant + sum of the members' coefficients."""
    return Utility("additive", lambda: F.col(coef), F.sum, _add,
                   lambda s: F.lit(float(constant)) + F.coalesce(s, F.lit(0)).cast("double"))


def member_mask(player: str = "player") -> Utility:
    """Bit mask of a coalition (players below 63), the join key of table games."""
    return Utility("member_mask", lambda: F.when(F.col(player) < 63, F.expr(f"shiftleft(1L, {player})")).otherwise(
        F.raise_error(F.lit("a mask holds players below 63")).cast("bigint")), F.sum, _add,
                   lambda s: F.coalesce(s, F.lit(0)).cast("bigint"))


def evaluate(sampled: Split, utility: Utility, with_rest: bool = False) -> Split:
    """Add `value` = v(S), and with_rest also `rest` = v(N without S), to sampled rows."""
    if isinstance(utility, BatchUtility):
        from allotment.operators.custom import evaluate_coalitions
        return evaluate_coalitions(sampled, utility, with_rest)

    def step(df: DataFrame, hot: bool) -> DataFrame:
        states = {"_in": utility.state(F.col("inside"))}
        if with_rest:
            states["_out"] = utility.state(~F.col("inside"))
        df = attach(df, SAMPLE, hot, **states).withColumn("value", utility.value(F.col("_in")))
        if with_rest:
            df = df.withColumn("rest", utility.value(F.col("_out")))
        return df.drop("_in", "_out")

    return sampled.map(step)


def evaluate_grouped(members: DataFrame, utility: Utility, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """One row per coalition from a table of member rows; `carry` columns are constant per coalition."""
    grouped = members.groupBy(*keys).agg(utility.state().alias("_state"), *[F.first(c).alias(c) for c in carry])
    return grouped.withColumn("value", utility.value(F.col("_state"))).drop("_state")


def prior_states(df: DataFrame, keys: list[str], order: str, bucket: Column, utility: Utility, name: str) -> DataFrame:
    """The state of all rows before this one: inside its bucket, merged with earlier buckets."""
    split = cut(df.withColumn("_bucket", bucket.cast("bigint")))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        split.groupBy(*keys, "_bucket").agg(utility.state().alias("_part"))
        .select(*keys, "_bucket", utility.fold(F.col("_part")).over(earlier).alias("_carried"))
    )
    return (
        split.withColumn("_local", utility.state().over(within))
        .join(carried, [*keys, "_bucket"])
        .withColumn(name, utility.merge(F.col("_carried"), F.col("_local")))
        .drop("_bucket", "_local", "_carried")
    )


def boundary(players: Split, utility: Utility) -> Split:
    """v(empty), v(all), v({i}) and v(N without i) beside every player.

    N without i is what comes before i merged with what comes after i in player
    order, so this never lists the n-1 members of any set (a BatchUtility must see them all).
    """
    if isinstance(utility, BatchUtility):
        from allotment.operators.custom import evaluate_boundary
        return evaluate_boundary(players, utility)

    def step(df: DataFrame, hot: bool) -> DataFrame:
        if not hot:
            # Two running frames; a frame to the end of the game would be quadratic.
            up = Window.partitionBy("game_id").orderBy("player").rowsBetween(Window.unboundedPreceding, -1)
            down = Window.partitionBy("game_id").orderBy(F.desc("player")).rowsBetween(Window.unboundedPreceding, -1)
            df = df.select("*", utility.state().over(down).alias("_after"), utility.state().over(up).alias("_before"))
        else:
            size = F.lit(hot_rows())
            df = prior_states(df, ["game_id"], "player", F.floor(F.col("player") / size), utility, "_before")
            df = df.withColumn("_down", -F.col("player"))
            df = prior_states(df, ["game_id"], "_down", F.floor(F.col("_down") / size), utility, "_after").drop("_down")
        rest = utility.merge(F.col("_before"), F.col("_after"))
        return (
            df.withColumn("empty_value", utility.of_empty())
            .withColumn("full_value", utility.value(utility.merge(rest, utility.own())))
            .withColumn("single_value", utility.value(utility.own()))
            .withColumn("without_value", utility.value(rest))
            .drop("_before", "_after")
        )

    return players.map(step)


def path_values(paths: Split, utility: Utility) -> Split:
    """Along every permutation: `before` and `value` around the player's arrival, and `marginal`."""
    if isinstance(utility, BatchUtility):
        from allotment.operators.custom import evaluate_paths
        return evaluate_paths(paths, utility)

    def step(df: DataFrame, hot: bool) -> DataFrame:
        if not hot:
            w = Window.partitionBy(*SAMPLE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
            df = df.withColumn("_prior", utility.state().over(w))
        else:
            df = prior_states(df, SAMPLE, "pos", key_bucket("key", F.col("n")), utility, "_prior")
        return (
            df.withColumn("before", utility.value(F.col("_prior")))
            .withColumn("value", utility.value(utility.merge(F.col("_prior"), utility.own())))
            .withColumn("marginal", F.col("value") - F.col("before"))
            .drop("_prior")
        )

    return paths.map(step)


def marginal_values(draws: DataFrame, players: DataFrame, utility: Utility) -> DataFrame:
    """(game_id, player, size, draw, n, with_value, without_value) of draws (player, size, draw, predecessors).

    A draw's predecessors fold into one state; the player's own part is merged into it, so with and without share the fold.
    """
    keys = ["game_id", "player", "size", "draw"]
    if isinstance(utility, BatchUtility):
        from allotment.operators.custom import evaluate_marginals
        return evaluate_marginals(draws, players, utility)
    others = players.drop("n").withColumnRenamed("player", "other")
    members = draws.select(*keys, F.explode_outer("predecessors").alias("other")).join(large(others), ["game_id", "other"], "left")
    states = members.groupBy(*keys).agg(utility.state().alias("_state"))
    both = states.join(large(players), ["game_id", "player"])
    return both.select(*keys, "n", utility.value(utility.merge(F.col("_state"), utility.own())).alias("with_value"),
                       utility.value(F.col("_state")).alias("without_value"))


def decode_boundary(stored: DataFrame) -> DataFrame:
    """(game_id, kind, player, utility) rows to one row per player; the ends sit on the row of player 0."""
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("utility")))
    own = stored.groupBy("game_id", "player").agg(pick("single").alias("single_value"), pick("loo").alias("without_value"))
    ends = stored.where(F.col("kind").isin("empty", "full")).groupBy("game_id").agg(
        pick("empty").alias("empty_value"), pick("full").alias("full_value"))
    return own.join(ends, "game_id").select("game_id", "player", "empty_value", "full_value", "single_value", "without_value")
