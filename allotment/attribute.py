"""One entry point: players + utility + method -> shares."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allotment.functions.laws import INNER, KERNEL
from allotment.operators import balanced as G
from allotment.operators import covered_pairs as C
from allotment.operators import designs as D
from allotment.operators import estimators as E
from allotment.operators import pairs as P
from allotment.operators.skew import Split, large
from allotment.operators.custom import evaluate_paths
from allotment.operators.utilities import BatchUtility, Utility, boundary, evaluate, marginal_values, path_values
from allotment.plans import budget as B
from allotment.plans import ledger as L

# Design defaults of the modes (candidate pool, lambda0).
DEFAULTS = {"greedy_by_size": (64, 1 / 16), "complete_orbits": (4, 0.0), "coupled": (32, 1.0),
            "stratified": (32, 1.0), "orbit": (32, 0.0)}
DESIGN_MODES = ["greedy_by_size", "complete_orbits", "iid", "coupled", "stratified", "orbit", "iid_linear"]
BASELINES = ["complementary", "differential", "stratified_differential", "group_testing", "kernel_shap", "gels", "permutation", "truncated",
             "antithetic", "latin_square", "component_array", "orthogonal", "stratified_marginal"]
MISSING = ("zero", "raise", "balanced")


class Budgeted(NamedTuple):
    """`shares`: (game_id, player, share, status) of every player; `runs`: the settled ledger, a row per game."""

    shares: DataFrame
    runs: DataFrame


def attribute(players: Split | DataFrame, utility: Utility, method: str = "greedy_by_size", per_player: int | Column = 4,
              seed: str = "0", *, pool: int | None = None, lambda0: float | None = None, missing: str = "zero",
              balance_mode: str = "normalized", profile: str | None = "endpoint",
              tolerance: float = 1e-3, patience: int = 5) -> DataFrame:
    """Shares (game_id, player, share) by one of DESIGN_MODES or BASELINES.

    `per_player` is the number of sampled calls per player: per_player * n coalitions (or pairs, or
    permutations of about n calls each), per_player complete orbits for the orbit modes; there it may be
    a column of the game's n. complete_orbits needs one orbit per inner size, so at least n - 3; stratified_marginal
    takes per_player samples of every cell (player, size), stratified_differential the calls its method asks for at least
    (`budgeted` takes a cap). Design modes need n >= 4. missing='zero' counts an unseen stratum as 0; 'raise' stops on it, and
    'balanced' (ratio estimates) also where a size's players are not seen equally often. A share that can not be told stops
    the job; `budgeted` gives it a status. `utility` may be a BatchUtility, for any method.
    """
    if isinstance(per_player, int) and per_player < 1:
        raise ValueError("per_player must be positive")
    split = _checked(players, method, missing)
    if method in DESIGN_MODES:
        split = split.map(lambda df, hot: df.withColumn("n", F.when(F.col("n") >= 4, F.col("n")).otherwise(
            F.raise_error(F.lit("design modes need at least 4 players")).cast("int"))))
    units = F.lit(per_player) if isinstance(per_player, int) else per_player
    n = F.col("n")
    if method == "stratified_differential":
        units = F.greatest(n * units, F.expr("ceil(6*n*ln(n) + 4*n*ln(n)*ln(n))"))
    elif method == "stratified_marginal":
        units = n * n * units
    elif method in L.ENDS or method == "complementary" or method in DESIGN_MODES and "orbit" not in method:
        units = n * units
    shares, _ = _run(split, utility, method, units, seed, pool, lambda0, missing, balance_mode, profile, tolerance, patience)
    if missing != "zero" and method in DESIGN_MODES or method in ("differential", "stratified_differential", "stratified_marginal"):
        shares = E.require_coverage(shares)
    return shares.select("game_id", "player", "share")


def budgeted(players: Split | DataFrame, utility: Utility, method: str, calls: int | Column, seed: str = "0", *, pool: int | None = None,
             lambda0: float | None = None, missing: str = "zero", balance_mode: str = "normalized", profile: str | None = "endpoint",
             tolerance: float = 1e-3, patience: int = 5) -> Budgeted:
    """`attribute` under a cap of utility calls per game, with the account of what was called.

    `calls` is a number or a column of the game's n. The ledger turns it into units of the method; games that can not pay for the
    least the method needs make no call, and their players get a null share with the ledger's status. A feasible game's player
    whose share can not be told has status 'uncovered'. No game calls more than its cap.

    runs.actual_calls counts the rows that were evaluated, not the plan: sampled coalitions (both sides of a pair), path
    prefixes short of v(all) (of a truncated path those up to its stop), and the fixed calls; reused ends count once.
    """
    split = _checked(players, method, missing)
    cap = F.lit(calls) if isinstance(calls, int) else calls
    games = split.rows().where("player = 0")
    names = split.rows().select("game_id", "player")
    if method == "stratified_differential":
        shares, counted, plan = _sdiff(boundary(split, utility), utility, cap - 2, seed)
        runs = plan.select("game_id", "n", F.lit(method).alias("method"), "target_calls", F.when(F.col("status") == L.OK, 2).otherwise(0).cast("bigint").alias("fixed_calls"),
                           F.col("random_calls").alias("units"), F.when(F.col("n") < 2, L.TOO_FEW).otherwise(F.col("status")).alias("status"))
    else:
        entry = L.entries(method, F.col("n"), cap)
        paid = split.map(lambda df, hot: df.where(entry["status"] == L.OK))
        shares, counted = _run(paid, utility, method, entry["units"], seed, pool, lambda0, missing, balance_mode, profile, tolerance, patience)
        runs = L.ledger(games, method, cap)
    runs = L.settled(runs, counted)
    told = names.join(large(shares.select("game_id", "player", "share")), ["game_id", "player"], "left").join(runs.select("game_id", "status"), "game_id")
    status = F.when((F.col("status") == L.OK) & F.col("share").isNull(), L.UNCOVERED).otherwise(F.col("status"))
    return Budgeted(told.select("game_id", "player", F.when(F.col("status") == L.OK, F.col("share")).alias("share"), status.alias("status")), runs)


def _checked(players: Split | DataFrame, method: str, missing: str) -> Split:
    if method not in DESIGN_MODES + BASELINES:
        raise ValueError(f"unknown method {method!r}")
    if missing not in MISSING:
        raise ValueError("missing must be 'zero', 'raise' or 'balanced'")
    return players if isinstance(players, Split) else Split(players)


def _run(split, utility, method, units, seed, pool, lambda0, missing, mode, profile, tolerance, patience):
    """(shares, sampled_calls per game) of `units` units of a method in every game."""
    split = boundary(split, utility)
    if method in DESIGN_MODES:
        return _design(split, utility, method, units, seed, pool, lambda0, missing, mode, profile)
    if method == "stratified_differential":
        return _sdiff(split, utility, units, seed)[:2]
    return _baseline(split, utility, method, units, seed, tolerance, patience)


def _coalitions(sampled: Split, sides: int = 1) -> DataFrame:
    """Calls of sampled coalitions: each has one row of player 0."""
    return sampled.rows().where("player = 0").groupBy("game_id").agg((F.count(F.lit(1)) * sides).alias("sampled_calls"))


def _prefixes(paths: Split, called: Column) -> DataFrame:
    """Calls along paths: the positions whose prefix is evaluated."""
    return paths.rows().groupBy("game_id").agg(F.sum(called.cast("bigint")).alias("sampled_calls"))


def _design(split, utility, method, units, seed, pool, lambda0, missing, mode, profile):
    split = E.boundary_part(split)
    if method in ("iid", "iid_linear"):
        sampled = evaluate(D.iid_design(split, units, seed, INNER), utility)
    else:
        k, lam = DEFAULTS[method]
        k, lam = pool or k, lam if lambda0 is None else lambda0
        rows = split.rows()
        games = rows.where("player = 0").select("game_id", "n")
        if method == "greedy_by_size":
            design = G.per_size_design(games, units, seed, pool=k, lambda0=lam, mode=mode)
        elif method == "coupled":
            design = G.coupled_design(games, units, seed, pool=k, lambda0=lam, mode=mode)
        elif method == "stratified":
            design = G.stratified_design(games, units, seed, pool=k, lambda0=lam, mode=mode)
        elif method == "complete_orbits":
            design = G.expand_orbits(G.orbit_base_design(games, units, seed, pool=k), seed)
        else:
            design = G.expand_orbits(G.coupled_orbit_bases(games, units, seed, pool=k), seed, per_size=False)
        sampled = evaluate(Split(G.sampled_rows(design, rows)), utility)
    if method in ("coupled", "orbit", "iid_linear"):
        shares = E.linear(sampled, profile)
    else:
        shares = E.stratified_linear(sampled) if method == "stratified" else E.ratio(sampled, missing)
    return shares, _coalitions(sampled)


def _sdiff(split, utility, units, seed):
    """Shares, sampled calls and plan of the stratified differential, `units` calls beside the two ends."""
    shares, plan = C.estimate(split.rows(), utility, units + 2, seed)
    return shares, plan.select("game_id", (F.col("covering_calls") + F.col("random_calls")).alias("sampled_calls")), plan


def _baseline(split, utility, method, units, seed, tolerance, patience):
    if method == "complementary":
        sampled = evaluate(D.complement_design(split, units, seed), utility, with_rest=True)
        return E.complementary(sampled), _coalitions(sampled, 2)
    if method in L.ENDS:
        sampled = evaluate(D.iid_design(split, units, seed, KERNEL), utility)
        if method in ("group_testing", "gels"):
            shares = E.group_testing(sampled) if method == "group_testing" else E.gels(sampled)
        else:
            shares = (P.kernel_shap if method == "kernel_shap" else P.differential)(sampled.rows(), split.rows())
        return shares, _coalitions(sampled)
    inner = F.col("pos") < F.col("n")
    if method == "permutation":
        paths = path_values(D.random_order(split, units, seed), utility)
        return E.permutation_mean(paths), _prefixes(paths, inner)
    if method == "truncated":
        orders = D.random_order(split, units, seed)
        if isinstance(utility, BatchUtility):  # valued place by place, so that what is cut off is never called
            paths = evaluate_paths(orders, utility, tolerance, True, patience)
        else:
            paths = E.truncate_paths(path_values(orders, utility), tolerance, True, patience)
        return E.truncated_mean(paths), _prefixes(paths, F.col("evaluated"))
    if method == "antithetic":
        paths = path_values(D.antithetic(split, units, seed), utility)
        return E.antithetic_mean(paths), _prefixes(paths, (F.col("pos") > 1) & (F.col("pos") < F.col("n") - 1))
    rows = split.rows()
    if method == "stratified_marginal":
        draws = D.predecessor_samples(B.marginal_counts(rows, 2 * units, seed), seed)
        samples = marginal_values(draws, rows, utility)
        return E.stratified_marginal(samples), samples.groupBy("game_id").agg((F.count(F.lit(1)) * 2).alias("sampled_calls"))
    games = rows.where("player = 0").select("game_id", "n")
    if method == "orthogonal":
        orders = D.reverse_pairs(D.with_own(G.orthogonal_orders(games, units, seed), rows))
    elif method == "latin_square":
        orders = D.latin_square(D.with_own(games, rows), units, seed)
    else:
        orders = D.component_array(D.with_own(games, rows), units, seed)
    paths = path_values(Split(orders), utility)
    return E.permutation_mean(paths) if method == "orthogonal" else E.block_mean(paths.rows()), _prefixes(paths, inner)
