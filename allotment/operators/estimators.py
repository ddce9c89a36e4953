"""Shapley estimators over sampled rows.

Input rows hold every player of every sampled coalition: (game_id, block, sample,
size, player, inside, value, n) plus the boundary columns of the player. Keeping
the outsiders makes slice totals and player sums two sides of one group-by, so no
estimator joins its sums back to totals, and the partial aggregation already
shrinks T*n rows to n (or n*sizes) before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allotment.functions.laws import harmonic, inner_total, kernel_total
from allotment.operators.skew import Split, attach, key_bucket
from allotment.operators.utilities import Utility, prior_states

GAME = ["game_id"]
PLAYER = ["game_id", "player"]
BOUNDARY = ["n", "empty_value", "full_value", "single_value", "without_value"]


def _keep(*names: str) -> list[Column]:
    return [F.first(c).alias(c) for c in names]


def boundary_part(players: Split) -> Split:
    """The exact share of sizes 0, 1, n-1 and n: adds `boundary_share`."""

    def step(df: DataFrame, hot: bool) -> DataFrame:
        df = attach(df, GAME, hot, _s=F.sum("single_value"), _l=F.sum("without_value"))
        n = F.col("n").cast("double")
        single, without = F.col("single_value"), F.col("without_value")
        others = F.greatest(n - 1, F.lit(1.0))
        share = ((F.col("full_value") - F.col("empty_value")) / n
                 + single / n - (F.col("_s") - single) / (n * others)
                 + (F.col("_l") - without) / (n * others) - without / n)
        return df.withColumn("boundary_share", share).drop("_s", "_l")

    return players.map(step)


def quadratic_shortcut(players: Split) -> DataFrame:
    """Half of first plus last marginal: exact for games of degree at most 2."""
    half = (F.col("single_value") - F.col("empty_value") + F.col("full_value") - F.col("without_value")) / 2
    return players.rows().select("game_id", "player", half.alias("share"))


def efficiency_offset(raw: Split, target: Column) -> Split:
    """Add the same amount to all players of a game so that shares sum to the target."""

    def step(df: DataFrame, hot: bool) -> DataFrame:
        df = attach(df, GAME, hot, _sum=F.sum("share"))
        return df.withColumn("share", F.col("share") + (target - F.col("_sum")) / F.col("n")).drop("_sum")

    return raw.map(step)


def _shares(split: Split) -> DataFrame:
    return split.rows().select("game_id", "player", "share")


def linear(sampled: Split, profile: str | None = "endpoint") -> DataFrame:
    """Coupled linear: boundary part + Z sqrt(n) mean of r*u over all sampled coalitions.

    `profile` is what is subtracted from v: 'endpoint' (the line from v(empty) to v(all)),
    None, or the name of a column holding any value that depends on the size only.
    """
    return linear_by(sampled, share=profile)


def linear_by(sampled: Split, **profiles: str | None) -> DataFrame:
    """`linear` with several profiles, a column each, in one pass over the sampled rows."""

    def step(df: DataFrame, hot: bool) -> DataFrame:
        n, s = F.col("n").cast("double"), F.col("size").cast("double")
        sums = []
        for name, profile in profiles.items():
            base = {None: F.lit(0.0),
                    "endpoint": F.col("empty_value") + s * (F.col("full_value") - F.col("empty_value")) / n,
                    }.get(profile, F.col(profile) if profile not in (None, "endpoint") else None)
            w = (F.col("value") - base) * F.sqrt(n / (s * (n - s)))
            sums += [F.sum(F.when(F.col("inside"), w).otherwise(0.0)).alias(f"{name}_member_sum"),
                     F.sum(w * s / n).alias(f"{name}_mean_sum")]
        sums = df.groupBy(*PLAYER).agg(*sums, F.count(F.lit(1)).alias("draws"), *_keep("n", "boundary_share"))
        moment = inner_total(F.col("n")) * F.sqrt(F.col("n").cast("double")) / F.col("draws")
        return sums.select("game_id", "player", *[(
            F.col("boundary_share") + moment * (F.col(f"{name}_member_sum") - F.col(f"{name}_mean_sum"))).alias(name) for name in profiles])

    return sampled.map(step).rows()


def _strata(df: DataFrame, *keep: str) -> DataFrame:
    """Per (game, player, size): coalitions and utility sums with the player, and of the whole slice."""
    return df.groupBy(*PLAYER, "size").agg(
        F.sum(F.when(F.col("inside"), 1).otherwise(0)).alias("in_rows"),
        F.sum(F.when(F.col("inside"), F.col("value"))).alias("in_sum"),
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"), *_keep(*keep))


def stratified_linear(sampled: Split) -> DataFrame:
    """Boundary part + sum over sizes of sqrt(n/(s(n-s))) * mean(r*u); every size must occur."""

    def step(df: DataFrame, hot: bool) -> DataFrame:
        n, s = F.col("n").cast("double"), F.col("size").cast("double")
        base = F.col("empty_value") + s * (F.col("full_value") - F.col("empty_value")) / n
        strata = _strata(df.withColumn("value", F.col("value") - base), "n", "boundary_share")
        mean = (F.coalesce(F.col("in_sum"), F.lit(0.0)) - F.col("total") * s / n) / F.col("rows")
        grouped = strata.groupBy(*PLAYER).agg(
            F.sum(mean * n / (s * (n - s))).alias("inner"), F.count(F.lit(1)).alias("sizes"),
            *_keep("n", "boundary_share"))
        return grouped.select("game_id", "player", F.when(
            F.col("sizes") == F.col("n") - 3, F.col("boundary_share") + F.col("inner")).alias("share"))

    return _shares(sampled.map(step))


def _ratio_gap(missing_zero: bool) -> Column:
    inside = F.col("in_sum") / F.nullif(F.col("in_rows"), F.lit(0))
    out_rows = F.col("rows") - F.col("in_rows")
    outside = (F.col("total") - F.coalesce(F.col("in_sum"), F.lit(0.0))) / F.nullif(out_rows, F.lit(0))
    if missing_zero:
        return F.coalesce(inside, F.lit(0.0)) - F.coalesce(outside, F.lit(0.0))
    return inside - outside


def ratio(sampled: Split, missing: str = "zero") -> DataFrame:
    """Boundary part + 1/n sum over sizes of mean v with i minus mean v without i.

    missing='zero': an unseen (player, size, side) counts 0. missing='raise': the
    share of a player with an unseen stratum is null here; `require_coverage` turns
    such rows into an error. missing='balanced': also requires equal counts per size.
    """

    def step(df: DataFrame, hot: bool) -> DataFrame:
        strata = _strata(df, "n", "boundary_share")
        if missing == "balanced":
            strata = attach(strata, ["game_id", "size"], hot, _lo=F.min("in_rows"), _hi=F.max("in_rows"))
        grouped = strata.groupBy(*PLAYER).agg(
            F.sum(_ratio_gap(missing == "zero")).alias("gap"),
            F.count(_ratio_gap(False)).alias("covered"),
            (F.max(F.col("_lo") != F.col("_hi")) if missing == "balanced" else F.lit(False)).alias("uneven"),
            *_keep("n", "boundary_share"))
        share = F.col("boundary_share") + F.coalesce(F.col("gap"), F.lit(0.0)) / F.col("n")
        if missing != "zero":
            share = F.when((F.col("covered") == F.col("n") - 3) & ~F.col("uneven"), share)
        return grouped.select("game_id", "player", share.alias("share"))

    return _shares(sampled.map(step))


def require_coverage(shares: DataFrame) -> DataFrame:
    """Run the estimate and fail when a share is missing; never fill in silently."""
    return shares.withColumn("share", F.when(
        F.col("share").isNull(),
        F.raise_error(F.concat(F.lit("player with unseen strata in game "), F.col("game_id").cast("string"))).cast("double"),
    ).otherwise(F.col("share")))


def complementary(sampled: Split) -> DataFrame:
    """CC: d = v(S) - v(N without S) enters (i, s) for members and -d enters (i, n-s) for the rest.

    Each stratum is averaged, unseen strata count 0, and the sum is divided by n.
    """

    def step(df: DataFrame, hot: bool) -> DataFrame:
        d = F.col("value") - F.col("rest")
        strata = df.select(
            *PLAYER, "n",
            F.when(F.col("inside"), F.col("size")).otherwise(F.col("n") - F.col("size")).alias("stratum"),
            F.when(F.col("inside"), d).otherwise(-d).alias("d"),
        ).groupBy(*PLAYER, "stratum").agg(F.avg("d").alias("mean"), *_keep("n"))
        return strata.groupBy(*PLAYER).agg((F.sum("mean") / F.first("n")).alias("share"))

    return _shares(sampled.map(step))


def group_testing(sampled: Split) -> DataFrame:
    """Z * mean((v - e) z_i), then the equal offset to v(all) - v(empty)."""

    def step(df: DataFrame, hot: bool) -> DataFrame:
        gain = F.when(F.col("inside"), F.col("value") - F.col("empty_value")).otherwise(0.0)
        sums = df.groupBy(*PLAYER).agg(F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("draws"),
                                       *_keep("n", "empty_value", "full_value"))
        return sums.withColumn("share", kernel_total(F.col("n")) * F.col("gain") / F.col("draws"))

    return _shares(efficiency_offset(sampled.map(step), F.col("full_value") - F.col("empty_value")))


def gels(sampled: Split) -> DataFrame:
    """H_(n-1) * mean(v : i in S), 0 when never seen, then the equal offset."""

    def step(df: DataFrame, hot: bool) -> DataFrame:
        sums = df.groupBy(*PLAYER).agg(
            F.avg(F.when(F.col("inside"), F.col("value"))).alias("mean"), *_keep("n", "empty_value", "full_value"))
        return sums.withColumn("share", harmonic(F.col("n") - 1) * F.coalesce(F.col("mean"), F.lit(0.0)))

    return _shares(efficiency_offset(sampled.map(step), F.col("full_value") - F.col("empty_value")))


def permutation_mean(paths: Split) -> DataFrame:
    """Mean marginal per player, its sample variance and the variance of the mean."""
    return paths.rows().groupBy(*PLAYER).agg(
        F.avg("marginal").alias("share"), F.var_samp("marginal").alias("variance"),
        (F.var_samp("marginal") / F.count("marginal")).alias("mean_variance"))


def truncate_paths(paths: Split, tolerance: float = 1e-3, relative: bool = True, patience: int = 5) -> Split:
    """Stop a path after patience+1 consecutive prefixes within tolerance of v(all).

    Adds `stop` (null when the path runs to its end) and zeroes later marginals.
    """
    sample = ["game_id", "block", "sample"]

    def step(df: DataFrame, hot: bool) -> DataFrame:
        slack = tolerance * F.abs(F.col("full_value")) if relative else F.lit(tolerance)
        away = ~(F.abs(F.col("full_value") - F.col("value")) <= slack)
        # The last position away from v(all) before each row starts the current run.
        df = df.withColumn("_away", F.when(away, F.col("pos")))
        if not hot:
            w = Window.partitionBy(*sample).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
            df = df.withColumn("_last", F.coalesce(F.max("_away").over(w), F.lit(0)))
        else:
            last = Utility("last", lambda: F.col("_away"), F.max, lambda a, b: F.greatest(a, b), lambda s: s)
            df = prior_states(df, sample, "pos", key_bucket("key", F.col("n")), last, "_prior")
            df = df.withColumn("_last", F.coalesce(F.greatest("_prior", "_away"), F.lit(0))).drop("_prior")
        reached = F.when(F.col("pos") - F.col("_last") > patience, F.col("pos"))
        df = attach(df, sample, hot, stop=F.min(reached)).drop("_away", "_last")
        kept = F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))
        return df.withColumn("evaluated", kept).withColumn("marginal", F.when(kept, F.col("marginal")).otherwise(0.0))

    return paths.map(step)


def truncated_mean(truncated: Split) -> DataFrame:
    return truncated.rows().groupBy(*PLAYER).agg(F.avg("marginal").alias("share"))


def truncation_accounting(truncated: Split, cap: Column) -> DataFrame:
    """Prefixes evaluated, truncation rate, mean prefix, calls and unused calls per game."""
    return truncated.rows().groupBy("game_id").agg(
        F.sum((F.col("pos") == 1).cast("bigint")).alias("permutations"),
        F.sum(F.col("evaluated").cast("bigint")).alias("prefixes"),
        F.sum(((F.col("pos") == 1) & F.col("stop").isNotNull()).cast("bigint")).alias("truncated"),
        F.first("n").alias("n"),
    ).select(
        "game_id", "permutations", "prefixes", "truncated",
        (F.col("truncated") / F.col("permutations")).alias("truncation_rate"),
        (F.col("prefixes") / F.col("permutations")).alias("mean_prefix"),
        (F.col("prefixes") + 2).alias("calls"),
        (cap - F.col("prefixes") - 2).alias("unused_calls"),
        (F.col("permutations") * F.col("n") - F.col("prefixes")).alias("saved_calls"))


def antithetic_mean(paths: Split) -> DataFrame:
    """Mean over pairs of the average of a path and its reverse; first and last steps
    reuse the boundary values v({i}) and v(N without i)."""
    marginal = (
        F.when(F.col("pos") == 1, F.col("single_value") - F.col("empty_value"))
        .when(F.col("pos") == F.col("n"), F.col("full_value") - F.col("without_value"))
        .otherwise(F.col("marginal")))
    pairs = paths.rows().groupBy(*PLAYER, "pair").agg(F.avg(marginal).alias("contribution"))
    return pairs.groupBy(*PLAYER).agg(
        F.avg("contribution").alias("share"), (F.var_samp("contribution") / F.count("contribution")).alias("mean_variance"))


def block_mean(paths: DataFrame) -> DataFrame:
    """Mean over complete blocks; the variance comes from block means, never from rows."""
    blocks = paths.groupBy(*PLAYER, "design_block").agg(F.avg("marginal").alias("mean"))
    return blocks.groupBy(*PLAYER).agg(
        F.avg("mean").alias("share"),
        F.when(F.count("mean") >= 2, F.var_samp("mean") / F.count("mean")).alias("mean_variance"))


def stratified_marginal(samples: DataFrame) -> DataFrame:
    """Mean v(S with i) - v(S) per (player, size), then the mean over the n sizes.

    `samples` has game_id, player, n, size, with_value, without_value. Cells with no sample leave
    the share null.
    """
    cells = samples.groupBy("game_id", "player", "size").agg(
        F.avg(F.col("with_value") - F.col("without_value")).alias("mean"), F.first("n").alias("n"))
    return cells.groupBy("game_id", "player").agg(
        F.when(F.count("mean") == F.first("n"), F.sum("mean") / F.first("n")).alias("share"))


def with_size_profile(sampled: Split) -> Split:
    """Add `profile`, the mean value of the game's sampled coalitions of the same size."""

    def step(df: DataFrame, hot: bool) -> DataFrame:
        return attach(df, ["game_id", "size"], hot, profile=F.avg("value"))

    return sampled.map(step)
