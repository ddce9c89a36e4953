"""Closed-form answers."""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allotment.operators.designs import shuffle_partitions
from allotment.operators.skew import cut, hot_rows, large, split_games


def airport_shares(rows: DataFrame) -> DataFrame:
    """Exact shares of a maximum cost: rows (game_id, cost, ...) gain `share`.

    Rows collapse to distinct (game, cost) levels first, so a hot game shuffles one row
    per level and task. A level adds (d_k - d_(k-1)) / #{players with cost >= d_k} to the
    share of everyone at or above it. Games with very many levels are scanned in two
    levels of equal cost ranges.
    """
    levels = rows.groupBy("game_id", "cost").agg(F.count(F.lit(1)).alias("players"))

    def step(df: DataFrame, hot: bool) -> DataFrame:
        if not hot:
            up = Window.partitionBy("game_id").orderBy("cost")
            down = Window.partitionBy("game_id").orderBy(F.desc("cost"))
            df = df.withColumn("above", F.sum("players").over(down))
            df = df.withColumn("inc", (F.col("cost") - F.coalesce(F.lag("cost").over(up), F.lit(0))) / F.col("above"))
            return df.select("game_id", "cost", F.sum("inc").over(up).alias("share"))
        # Ranges of the cost axis: totals per range, then a scan inside each range.
        width = F.ceil(F.col("game_rows") / F.lit(hot_rows()))
        df = cut(df.withColumn("part", F.floor(
            (F.col("cost") - F.col("lead_low")) / (F.col("lead_high") - F.col("lead_low") + 1.0) * width)))
        lower = Window.partitionBy("game_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        higher = Window.partitionBy("game_id").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
        parts = df.groupBy("game_id", "part").agg(F.sum("players").alias("_p"), F.max("cost").alias("_top"))
        parts = parts.select("game_id", "part", F.coalesce(F.sum("_p").over(higher), F.lit(0)).alias("_above"),
                             F.coalesce(F.max("_top").over(lower), F.lit(0)).alias("_floor"))
        up = Window.partitionBy("game_id", "part").orderBy("cost")
        down = Window.partitionBy("game_id", "part").orderBy(F.desc("cost"))
        df = df.join(parts, ["game_id", "part"]).withColumn("above", F.col("_above") + F.sum("players").over(down))
        df = df.withColumn("inc", (F.col("cost") - F.coalesce(F.lag("cost").over(up), F.col("_floor"))) / F.col("above"))
        df = cut(df)
        sums = df.groupBy("game_id", "part").agg(F.sum("inc").alias("_inc"))
        sums = sums.select("game_id", "part", F.coalesce(F.sum("_inc").over(lower), F.lit(0.0)).alias("_carried"))
        return df.join(sums, ["game_id", "part"]).select(
            "game_id", "cost", (F.col("_carried") + F.sum("inc").over(up)).alias("share"))

    shares = split_games(levels, "cost", counted=rows).map(step).rows()
    return rows.join(large(shares), ["game_id", "cost"])


def term_shares(terms: DataFrame) -> DataFrame:
    """Exact shares of an interaction game: every term splits its weight equally.

    `terms` is long: (game_id, term_id, player, weight, degree), one row per member.
    """
    return terms.groupBy("game_id", "player").agg(F.sum(F.col("weight") / F.col("degree")).alias("share"))


def all_coalitions(games: DataFrame, limit: int = 20) -> DataFrame:
    """Every subset of every game as a bit mask: (game_id, n, mask). Games must have n <= limit."""
    n = F.when(F.col("n") <= limit, F.col("n")).otherwise(
        F.raise_error(F.lit(f"exhaustive enumeration needs at most {limit} players")).cast("int"))
    spread = games.select("game_id", "n").repartition(shuffle_partitions(), "game_id")
    last = F.pow(F.lit(2.0), n).cast("bigint") - 1
    return spread.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def exhaustive_shares(table: DataFrame) -> DataFrame:
    """Shapley by factorial weights over a full table (game_id, n, mask, utility).

    phi_i = sum over S with i of (s-1)!(n-s)!/n! v(S) - sum over S without i of s!(n-s-1)!/n! v(S).
    """
    n, s = F.col("n"), F.bit_count("mask")
    rows = table.withColumn("s", s).withColumn("player", F.explode(F.sequence(F.lit(0), n - 1)))
    inside = F.expr("shiftright(mask, player) & 1") == 1
    fact = lambda k: F.factorial(k).cast("double")
    weight = F.when(inside, fact(F.greatest(F.col("s") - 1, F.lit(0))) * fact(n - F.col("s"))).otherwise(
        -fact(F.col("s")) * fact(F.greatest(n - F.col("s") - 1, F.lit(0)))) / fact(n)
    return rows.groupBy("game_id", "player").agg(F.sum(weight * F.col("utility")).alias("share"))


def power_index(players: DataFrame) -> DataFrame:
    """Exact Shapley-Shubik index per game from (game_id, player, weight, quota).

    One voting body is one group of n rows; bodies run in parallel. Counts of subsets by (size,
    weight) are exact integers.
    """
    def rows(players, weights, quota):
        return players, swing_shares(weights, quota)

    return _per_body(players, rows, "player", "share")


def _per_body(players: DataFrame, work, key: str, value: str) -> DataFrame:
    """Pack every voting body into one row and solve bodies batch by batch."""
    packed = players.groupBy("game_id").agg(
        F.collect_list("player").alias("players"), F.collect_list("weight").alias("weights"), F.first("quota").alias("quota"))

    def solve(batches):
        for pdf in batches:
            parts = [(r.game_id, *work(r.players, r.weights, int(r.quota))) for r in pdf.itertuples(index=False)]
            if parts:
                yield pd.DataFrame({"game_id": np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]),
                                    key: np.concatenate([p[1] for p in parts]), value: np.concatenate([p[2] for p in parts])})

    spread = packed.repartition(shuffle_partitions(), "game_id")
    return spread.mapInPandas(solve, f"game_id BIGINT, {key} INT, {value} DOUBLE")


def subset_counts(weights, quota: int):
    """counts[s][w]: subsets of size s and total weight w < quota, as exact integers."""
    # C(60, 30) still fits 64 bits; larger bodies need Python integers.
    counts = np.zeros((len(weights) + 1, quota), dtype=np.int64 if len(weights) <= 60 else object)
    counts[0, 0] = 1
    return joined_by(counts, weights)


def joined_by(counts, weights):
    """The counts of subset_counts after voters of these weights have joined the body."""
    counts = counts.copy()
    for w in map(int, weights):
        if w < counts.shape[1]:
            counts[1:, w:] += counts[:-1, :counts.shape[1] - w].copy()
    return counts


def swing_shares(weights, quota: int) -> list[float]:
    """Index per player: the chance, over random orders, that S loses and S with i wins.

    The counts of the body without i come from halving: whoever is in one half of the players still
    in question needs the other half joined, down to a single player. Equal weights share one answer.
    """
    weights = [int(w) for w in weights]
    n, kinds = len(weights), sorted(set(weights))
    rest = list(weights)
    for w in kinds:
        rest.remove(w)
    empty = subset_counts([], quota).astype(np.int64 if n <= 60 else object)
    start = joined_by(np.concatenate([empty, np.zeros((n, quota), dtype=empty.dtype)]), rest)
    share, open_halves = {}, [(kinds, start)]
    while open_halves:
        asked, counts = open_halves.pop()
        if len(asked) > 1:
            middle = len(asked) // 2
            low, high = asked[:middle], asked[middle:]
            open_halves += [(low, joined_by(counts, high)), (high, joined_by(counts, low))]
            continue
        swings = counts[:n, max(0, quota - asked[0]):].sum(axis=1)
        share[asked[0]] = float(sum(Fraction(int(c), n * comb(n - 1, s)) for s, c in enumerate(swings)))
    return [share[w] for w in weights]


def win_probability_by_size(players: DataFrame) -> DataFrame:
    """Share of winning coalitions at every size 0..n, per voting body."""
    def rows(_, weights, quota):
        n = len(weights)
        losing = subset_counts(weights, quota).sum(axis=1)
        return np.arange(n + 1), [1 - float(losing[s]) / comb(n, s) for s in range(n + 1)]

    return _per_body(players, rows, "size", "probability")


def mean_cost_by_size(rows: DataFrame) -> DataFrame:
    """Mean airport value at every size 1..n: the top cost less, over levels, (d_k - d_(k-1)) C(low,s)/C(n,s).

    low = players cheaper than the level; sizes above it have ratio 0 and no row. A level's ratios are one running sum of
    logarithms over its sizes, so a game costs (levels * n) steps. Levels are dealt out before their sizes are listed, so the
    levels of one game fill many tasks, and only partial sums by size are shuffled after that.
    """
    levels = rows.groupBy("game_id", "cost").agg(F.count(F.lit(1)).alias("players"))

    up = Window.partitionBy("game_id").orderBy("cost")
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    steps = levels.select(
        "game_id", (F.col("cost") - F.coalesce(F.lag("cost").over(up), F.lit(0))).alias("rise"),
        F.coalesce(F.sum("players").over(below), F.lit(0)).alias("low"),
        F.sum("players").over(Window.partitionBy("game_id")).alias("n"), F.max("cost").over(Window.partitionBy("game_id")).alias("top"))

    size = Window.partitionBy("game_id", "low").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    sized = steps.where("low > 0").repartition(shuffle_partitions(), "game_id", "low").withColumn(
        "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("low"))))
    factor = (F.col("low") - F.col("size") + 1) / (F.col("n") - F.col("size") + 1)
    missed = sized.select("game_id", "size", (F.col("rise") * F.exp(F.sum(F.log(factor)).over(size))).alias("missed"))
    tops = steps.where("low = 0").select("game_id", "top", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("size"))
    whole = tops.select("game_id", "size", F.col("top").cast("double").alias("value"))
    return whole.unionByName(missed.select("game_id", "size", (-F.col("missed")).alias("value"))).groupBy("game_id", "size").agg(
        F.sum("value").alias("mean_value"))
