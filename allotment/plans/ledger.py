"""Call ledgers: what a cap on utility calls buys for each method, game by game, as columns of n and the cap.

A ledger row says how many calls go to fixed coalitions (the ends, or the whole boundary), how many units of the method the rest
pays for (coalitions, pairs, paths, blocks, orbits), what a unit costs, and whether the method can run at all.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allotment.operators.skew import large
from allotment.plans import budget as B

OK, TOO_FEW, INFEASIBLE, UNCOVERED = "ok", "too_few_players", "budget_infeasible", "uncovered"
DESIGNS = ("greedy_by_size", "iid", "iid_linear", "coupled", "stratified", "complete_orbits", "orbit")
ENDS = ("group_testing", "gels", "kernel_shap", "differential")


class Price(NamedTuple):
    """Calls for fixed coalitions and for a unit, the least units and players the method takes, and the name of a unit."""

    fixed: Column
    unit: Column
    least: Column
    players: int
    name: str


def price(method: str, n: Column) -> Price:
    """The price list: `n` is the number of players."""
    n = n.cast("bigint")
    one, whole, ends = F.lit(1).cast("bigint"), 2 * n + 2, F.lit(2).cast("bigint")
    sizes = F.greatest(n - 3, one)
    if method in ("complete_orbits", "orbit"):
        return Price(whole, n, sizes if method == "complete_orbits" else one, 4, "orbit")
    if method in DESIGNS:
        return Price(whole, one, sizes if method == "stratified" else one, 4, "coalition")
    if method in ENDS:
        return Price(ends, one, one, 2, "coalition")
    if method == "complementary":
        return Price(F.lit(0).cast("bigint"), ends, one, 1, "pair of complements")
    if method == "stratified_marginal":
        return Price(F.lit(0).cast("bigint"), ends, n * n, 1, "marginal")
    if method == "permutation":
        return Price(ends, n - 1, one, 1, "path")
    if method == "truncated":
        return Price(ends, n, one, 1, "path")
    if method == "antithetic":
        return Price(whole, F.greatest(2 * (n - 3), F.lit(0)), one, 1, "pair of paths")
    if method == "orthogonal":
        return Price(ends, 2 * (n - 1), one, 2, "pair of paths")
    if method in ("latin_square", "component_array"):
        rows = B.block_plan(n.cast("int"), F.lit(0), "ls" if method == "latin_square" else "coa")["rows_per_block"]
        return Price(ends, rows * (n - 1), one, 1, "block")
    raise ValueError(f"no price for {method!r}")


def entries(method: str, n: Column, cap: Column) -> dict[str, Column]:
    """fixed_calls, units, unit_calls and status of a game with `n` players under `cap`.

    Where a unit costs nothing beside the fixed calls (a path of one player), one is bought. A game that can not pay for the
    least number of units gets none and makes no call.
    """
    p, cap = price(method, n), cap.cast("bigint")
    bought = F.when(p.unit == 0, F.when(cap >= p.fixed, 1).otherwise(0)).otherwise(
        F.greatest(F.lit(0), F.floor((cap - p.fixed) / F.greatest(p.unit, F.lit(1)))))
    status = F.when(n < p.players, TOO_FEW).when(p.unit.isNull() | (cap < p.fixed) | (bought < p.least), INFEASIBLE).otherwise(OK)
    good = status == OK
    return {"fixed_calls": F.when(good, p.fixed).otherwise(0).cast("bigint"), "units": F.when(good, bought).otherwise(0).cast("bigint"),
            "unit_calls": p.unit.cast("bigint"), "status": status}


def ledger(games: DataFrame, method: str, cap: Column) -> DataFrame:
    """(game_id, n, method, target_calls, fixed_calls, units, unit_calls, status), one row per game (game_id, n, and what `cap` needs)."""
    made = entries(method, F.col("n"), cap)
    return games.select("game_id", "n", F.lit(method).alias("method"), cap.cast("bigint").alias("target_calls"), *[c.alias(k) for k, c in made.items()])


def settled(ledger_rows: DataFrame, counted: DataFrame) -> DataFrame:
    """The ledger with the calls that were made: `counted` has game_id and sampled_calls of the rows that were evaluated."""
    made = ledger_rows.join(large(counted), "game_id", "left")
    actual = F.col("fixed_calls") + F.coalesce(F.col("sampled_calls"), F.lit(0)).cast("bigint")
    return made.select("game_id", "n", "method", "target_calls", "fixed_calls", "units", actual.alias("actual_calls"),
                       (F.col("target_calls") - actual).alias("unused_calls"), "status")
