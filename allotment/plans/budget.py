"""Call budgets as columns: how many samples a cap buys, per game.

Input tables are keyed by game_id with `n` players; everything is arithmetic on
columns or a small explode per game, so no plan ever needs a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allotment.functions.hashing import order_key
from allotment.functions.laws import SizeLaw
from allotment.operators.skew import key_bucket, large

# The grid defaults of the comparison experiments.
MULTIPLIERS = [500, 1000, 2000, 5000, 10000]


def budget_grid(games: DataFrame, multipliers: list[int]) -> DataFrame:
    """inner = n * multiplier and total = inner + 2n + 2; multipliers must increase strictly."""
    if any(b <= a for a, b in zip(multipliers, multipliers[1:])) or not multipliers or multipliers[0] < 1:
        raise ValueError("budget multipliers must be positive and strictly increasing")
    grid = games.select("game_id", "n", F.posexplode(F.array(*[F.lit(m) for m in multipliers])).alias("budget_index", "multiplier"))
    inner = F.col("n").cast("bigint") * F.col("multiplier")
    return grid.withColumn("inner_calls", inner).withColumn("total_calls", inner + 2 * F.col("n") + 2)


def full_permutations(n: Column, cap: Column) -> tuple[Column, Column, Column]:
    """(permutations, calls, unused): two endpoints once, then n-1 calls per permutation."""
    many = F.greatest(F.lit(0), F.floor((cap - 2) / F.greatest(n - 1, F.lit(1)))).cast("bigint")
    count = F.when(n == 1, F.when(cap >= 2, 1).otherwise(0)).otherwise(many).cast("bigint")
    calls = F.when(count > 0, F.when(n == 1, 2).otherwise(count * (n - 1) + 2)).otherwise(0).cast("bigint")
    return count, calls, cap - calls


def truncated_permutations(n: Column, cap: Column) -> tuple[Column, Column, Column]:
    """(permutations, worst-case reserve, remainder): n calls per path, truncation may save some."""
    count = F.greatest(F.lit(0), F.floor((cap - 2) / n)).cast("bigint")
    return count, count * n + 2, cap - count * n - 2


def orthogonal_plan(n: Column, cap: Column) -> dict[str, Column]:
    """Complete reverse pairs, n-1 directions per full block, the rest in a tail block."""
    pairs = F.when(n > 1, F.greatest(F.lit(0), F.floor((cap - 2) / (2 * F.greatest(n - 1, F.lit(1)))))).otherwise(0).cast("bigint")
    width = F.greatest(n - 1, F.lit(1))
    full = F.floor(pairs / width).cast("bigint")
    return {"permutations": pairs * 2, "full_blocks": full, "tail_pairs": pairs - full * width,
            "calls": F.when((cap >= 2) & ((pairs > 0) | (n == 1)), pairs * 2 * (n - 1) + 2).otherwise(0).cast("bigint")}


def is_prime_power(value: int) -> tuple[int, int] | None:
    """(p, k) with p**k == value, or None."""
    p = next((d for d in range(2, int(value**0.5) + 1) if value % d == 0), value)
    k, rest = 0, value
    while p > 1 and rest % p == 0:
        k, rest = k + 1, rest // p
    return (p, k) if rest == 1 and k else None


def field_orders(limit: int) -> list[tuple[int, int]]:
    """(n, smallest prime power >= n) for n = 1..limit."""
    out, q = [], 2
    for n in range(1, limit + 1):
        while q < max(2, n) or is_prime_power(q) is None:
            q += 1
        out.append((n, q))
    return out


def least_field(n: int) -> int:
    """The smallest prime power >= n, without a bound."""
    q = max(2, n)
    while is_prime_power(q) is None:
        q += 1
    return q


#: Component arrays need q(q-1) rows of q symbols; no calls are planned above this order (the design itself has no such bound).
LARGEST_FIELD = 4096


def field_order(n: Column) -> Column:
    """The smallest prime power >= n, looked up among the prime powers up to LARGEST_FIELD; null beyond."""
    powers = sorted({q for _, q in field_orders(LARGEST_FIELD)})
    return F.get(F.filter(F.array(*[F.lit(q) for q in powers]), lambda q: q >= n), F.lit(0))


def block_plan(n: Column, cap: Column, method: str) -> dict[str, Column]:
    """Latin squares ('ls', n rows per block) or component arrays ('coa', q(q-1) rows)."""
    q = field_order(n)
    rows = n.cast("bigint") if method == "ls" else (q * (q - 1)).cast("bigint")
    cost = rows * (n - 1)
    blocks = F.when((cost > 0) & (cap >= cost + 2), F.floor((cap - 2) / F.greatest(cost, F.lit(1)))).otherwise(0).cast("bigint")
    return {"rows_per_block": rows, "blocks": blocks,
            "calls": F.when((cap >= 2) & ((blocks > 0) | (n == 1)), blocks * cost + 2).otherwise(0).cast("bigint"),
            "status": F.when((blocks > 0) | ((n == 1) & (cap >= 2)), "ok").otherwise("budget_infeasible")}


def complement_plan(cap: Column) -> dict[str, Column]:
    """CC spends two calls per pair and has no endpoints; an odd cap leaves one call unused."""
    pairs = F.floor(cap / 2).cast("bigint")
    return {"pairs": pairs, "calls": pairs * 2, "unused": cap - pairs * 2, "even": cap % 2 == 0}


def per_player_rows(n: Column, per_player: Column, mode: Column) -> Column:
    """per_player * n sampled rows, or per_player complete orbits for the orbit modes."""
    return F.when(mode.isin("orbit", "complete_orbits"), per_player).otherwise(per_player * n).cast("bigint")


def marginal_counts(players: DataFrame, cap: Column, seed: str) -> DataFrame:
    """Stratified marginal sampling: floor(cap/2) samples over the n*n cells (player, size 0..n-1).

    Counts differ by at most one; the cells that get one more are the first in hash order. Their ranks are taken within even
    buckets of the hash and set off by the counts of earlier buckets, so no task holds all n*n cells of a large game.
    """
    cells = players.select("game_id", "player", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("size"))
    area = F.col("n").cast("bigint") * F.col("n")
    cells = cells.withColumn("_key", order_key(seed, F.lit("cell"), F.col("game_id"), F.col("player"), F.col("size"))).withColumn(
        "_bucket", key_bucket("_key", area))
    earlier = Window.partitionBy("game_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.groupBy("game_id", "_bucket").agg(F.count("*").alias("_rows")).select(
        "game_id", "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("game_id", "_bucket").orderBy("_key", "player", "size"))
    rank = F.col("_within") + F.col("_before")
    samples = F.floor(cap / 2).cast("bigint")
    count = F.floor(samples / area) + F.when(rank <= samples % area, 1).otherwise(0)
    return cells.withColumn("_within", within).join(large(before), ["game_id", "_bucket"]).withColumn("count", count.cast("bigint")).drop(
        "_key", "_bucket", "_before", "_within")


def minimum_one_counts(games: DataFrame, samples: Column, law: SizeLaw) -> DataFrame:
    """Integer counts >= 1 per size, summing to `samples`, nearest to samples*q in squares.

    Start at max(1, floor). Missing units go to the largest deficits; surplus units leave
    where the excess is largest, unit by unit, as ranked unit steps (lowest size on ties).
    A game with fewer samples than sizes has no such counts and stops the job.
    """
    per_game = Window.partitionBy("game_id")
    base = (
        games.withColumn("samples", samples.cast("bigint")).withColumn("z", law.total(F.col("n")))
        .withColumn("size", F.explode(law.sizes(F.col("n"))))
        .withColumn("target", F.col("samples") * law.weight(F.col("size"), F.col("n")) / F.col("z"))
        .withColumn("start", F.greatest(F.lit(1), F.floor("target")).cast("bigint"))
        .select("game_id", "n", "samples", "size", "target", "start",
                F.sum("start").over(per_game).alias("total"), F.count(F.lit(1)).over(per_game).alias("sizes"))
        .withColumn("samples", F.when(F.col("samples") >= F.col("sizes"), F.col("samples")).otherwise(
            F.raise_error(F.lit("a game has fewer samples than sizes")).cast("bigint")))
    )
    grow = F.col("total") < F.col("samples")
    steps = base.withColumn("k", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.when(grow | (F.col("start") == 1), F.lit(0)).otherwise(F.col("start") - 2).cast("bigint"))))
    gain = F.when(grow, F.col("target") - F.col("start")).otherwise(F.col("start") - F.col("k") - F.col("target"))
    usable = grow | (F.col("start") > 1)
    ranked = steps.withColumn("rank", F.row_number().over(
        per_game.orderBy(F.desc(usable), F.desc(gain), "size", "k")))
    taken = (usable & (F.col("rank") <= F.abs(F.col("samples") - F.col("total")))).cast("bigint")
    sign = F.when(F.first("total") < F.first("samples"), 1).otherwise(-1)
    return ranked.withColumn("taken", taken).groupBy("game_id", "n", "samples", "size").agg(
        F.first("target").alias("target"), (F.first("start") + sign * F.sum("taken")).cast("bigint").alias("count"))


def tuning_grid(games: DataFrame, lambdas: list[float], pools: list[int],
                default_lambda: float = 1.0, default_pool: int = 4) -> DataFrame:
    """lambda x K per game; K=1 keeps the default lambda only; the default pair is always there."""
    pairs = [(float(l), int(k)) for k in pools for l in (lambdas if k > 1 else [default_lambda])]
    pairs.append((default_lambda, default_pool))
    cells = F.array_distinct(F.array(*[F.struct(F.lit(l).alias("lambda0"), F.lit(k).alias("candidate_pool")) for l, k in pairs]))
    return games.select("game_id", F.inline(cells))


def one_at_a_time_grid(games: DataFrame, lambdas: list[float], pools: list[int],
                       default_lambda: float = 1 / 16, default_pool: int = 64) -> DataFrame:
    """Vary K at the default lambda, and lambda at the default K."""
    pairs = [(default_lambda, int(k)) for k in pools] + [(float(l), default_pool) for l in lambdas]
    cells = F.array_distinct(F.array(*[F.struct(F.lit(l).alias("lambda0"), F.lit(k).alias("candidate_pool")) for l, k in pairs]))
    return games.select("game_id", F.inline(cells))


def cell_seed(base: str, *keys: Column) -> Column:
    """A seed per experiment cell that depends on its key columns only."""
    return F.md5(F.concat_ws("|", F.lit(base), *[k.cast("string") for k in keys]))
