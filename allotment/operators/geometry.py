"""Diagnostics of a design: how evenly it covers players, sizes and directions.

Input rows hold every player of every sampled coalition (see estimators). A direction is
u = sqrt(n/(s(n-s))) (z - s/n). Sums over directions are expanded into sums over members,
so directions themselves are never stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allotment.functions.laws import inner_total
from allotment.operators.designs import WHOLE, shuffle_partitions
from allotment.operators.pairs import _rest, _tiles, co_membership, whole_games
from allotment.operators.skew import large

PLAYER = ["game_id", "player"]


def directions(sampled: DataFrame) -> DataFrame:
    """Unit directions of every coalition, one row per player: for small outputs only."""
    n, s = F.col("n").cast("double"), F.col("size").cast("double")
    u = F.sqrt(n / (s * (n - s))) * (F.col("inside").cast("double") - s / n)
    return sampled.select("game_id", "sample", "player", u.alias("u"))


def targets(players: DataFrame) -> DataFrame:
    """Projector P = I - 11'/n, inner target (n-3)/(n-1) P and slice target P/(n-1)."""
    n = F.col("n").cast("double")
    cells = players.select("game_id", "n", F.col("player").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    p = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - 1.0 / n
    return cells.select("game_id", "i", "j", p.alias("projector"), (p * (n - 3) / (n - 1)).alias("inner_target"), (p / (n - 1)).alias("slice_target"))


def inner_frame(sampled: DataFrame) -> DataFrame:
    """F = Z/T sum of sqrt(s(n-s)) u u' per game, with its target: (game_id, n, i, j, operator, target).

    Games whose samples are in one block are finished in their task; the others' pairs are summed over tasks.
    """
    whole = whole_games(sampled, _frames, "game_id BIGINT, n INT, i INT, j INT, operator DOUBLE, target DOUBLE")
    sampled = _rest(sampled)
    n, s = F.col("n").cast("double"), F.col("size").cast("double")
    c = n / F.sqrt(s * (n - s))
    weighted = sampled.withColumn("c", c).withColumn("value", F.lit(0.0))
    co = co_membership(weighted, weight="c").select("game_id", "i", "j", "weighted")
    own = weighted.groupBy(*PLAYER).agg(
        F.first("n").alias("n"), F.sum(F.when(F.col("inside"), F.col("c") * s / n).otherwise(0.0)).alias("pull"),
        F.sum(F.col("c") * s * s / (n * n)).alias("level"), F.count(F.lit(1)).alias("draws"))
    left = own.select("game_id", "n", F.col("player").alias("i"), F.col("pull").alias("pull_i"), "level", "draws",
                      F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    right = own.select("game_id", F.col("player").alias("j"), F.col("pull").alias("pull_j"))
    cells = left.join(large(right), ["game_id", "j"]).join(large(co), ["game_id", "i", "j"], "left").fillna(0.0, ["weighted"])
    operator = inner_total(F.col("n")) / F.col("draws") * (F.col("weighted") - F.col("pull_i") - F.col("pull_j") + F.col("level"))
    m = F.col("n").cast("double")
    target = (F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - 1 / m) * (m - 3) / (m - 1)
    return cells.select("game_id", "n", "i", "j", operator.alias("operator"), target.alias("target")).unionByName(whole)


def _cells(game, width, tile, *columns):
    """Matrices (game, row of the tile, player) as columns (place of the game, i, j, *columns)."""
    shape = columns[0].shape
    at, i, j = (a.ravel() for a in np.indices(shape))
    return at, i + tile.start, j, *(c.ravel() for c in columns)


def _target(width, tile):
    """Rows of the projector I - 11'/n."""
    return np.eye(width)[tile] - 1 / width


def _frames(ids, n, made):
    for (game, _), z, _, size in made(False):
        m = z.shape[2]
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.where(size > 0, m / np.sqrt(size * (m - size)), 0.0)
            total = sum(1 / np.sqrt(s * (m - s)) for s in range(2, max(m - 2, 2) + 1))
        draws = (size > 0).sum(axis=1)[:, :, None]
        pull, level = (z * c * size / m).sum(axis=1), (c * size * size / (m * m)).sum(axis=1)[:, :, None]
        for tile in _tiles(z):
            weighted = z[:, :, tile].transpose(0, 2, 1) @ (z * c)
            operator = total / draws * (weighted - pull[:, tile, None] - pull[:, None, :] + level)
            target = np.broadcast_to(_target(m, tile) * (m - 3) / (m - 1), operator.shape)
            at, i, j, a, b = _cells(game, m, tile, operator, target)
            yield ids[game][at], np.full(len(at), m), i, j, a, b


def frame_discrepancy(frame: DataFrame) -> DataFrame:
    """Frobenius and trace discrepancy per game."""
    gap = F.col("operator") - F.col("target")
    return frame.groupBy("game_id").agg(
        F.sqrt(F.sum(gap * gap)).alias("frobenius"), F.sum(F.when(F.col("i") == F.col("j"), gap).otherwise(0.0)).alias("trace"))


def spectral_discrepancy(frame: DataFrame) -> DataFrame:
    """Largest absolute eigenvalue of operator - target per game: one n*n matrix per row of a pack."""
    packed = frame.groupBy("game_id").agg(F.first("n").alias("n"), F.collect_list("i").alias("i"), F.collect_list("j").alias("j"),
                                          F.collect_list(F.col("operator") - F.col("target")).alias("gap"))

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                m = np.zeros((int(r.n), int(r.n)))
                m[r.i, r.j] = r.gap
                out.append(float(np.abs(np.linalg.eigvalsh((m + m.T) / 2)).max()))
            yield pd.DataFrame({"game_id": pdf["game_id"], "spectral": out})

    return packed.repartition(shuffle_partitions(), "game_id").mapInPandas(solve, "game_id BIGINT, spectral DOUBLE")


def strata_counts(sampled: DataFrame) -> DataFrame:
    """(game, size, player): coalitions of the size, and those holding the player.

    Games in one block are counted by it, where their rows are, without a shuffle.
    """
    counts = [F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("inside").cast("bigint")).alias("holding")]
    keys = ["game_id", "size", "player"]
    if "block" not in sampled.columns:
        return sampled.groupBy(*keys).agg(*counts)
    whole = sampled.where(f"block = {WHOLE}").groupBy(*keys, "block").agg(*counts).drop("block")
    return whole.unionByName(_rest(sampled).groupBy(*keys).agg(*counts))


def slice_means(counts: DataFrame) -> DataFrame:
    """Squared norm of the mean direction per (game, size); exactly 0 when all counts are rows*s/n."""
    n, s = F.col("n").cast("double"), F.col("size").cast("double")
    gap = F.when(F.col("holding") * F.col("n") == F.col("size") * F.col("rows"), 0.0).otherwise(F.col("holding") / F.col("rows") - s / n)
    return counts.groupBy("game_id", "size").agg(
        F.first("n").alias("n"), F.first("rows").alias("rows"), F.sum(n / (s * (n - s)) * gap * gap).alias("first_squared"))


def mean_direction(counts: DataFrame) -> DataFrame:
    """Norm of the mean direction over all rows, RMS and worst slice mean, per game."""
    n, s = F.col("n").cast("double"), F.col("size").cast("double")
    pull = F.sqrt(n / (s * (n - s))) * (F.col("holding") - F.col("rows") * s / n)
    overall = counts.groupBy("game_id", "player").agg(F.sum(pull).alias("p"), F.sum("rows").alias("t")).groupBy("game_id").agg(
        F.sqrt(F.sum(F.col("p") * F.col("p") / (F.col("t") * F.col("t")))).alias("mean_direction"))
    slices = slice_means(counts).groupBy("game_id").agg(
        F.sqrt(F.avg("first_squared")).alias("slice_rms"), F.sqrt(F.max("first_squared")).alias("slice_worst"))
    return overall.join(large(slices), "game_id")


def slice_frames(sampled: DataFrame) -> DataFrame:
    """Operator minus target of every size: (game_id, n, size, rows, i, j, gap).

    M_ij = n/(s(n-s)) (N_ij/m - s/n (m_i+m_j)/m + s^2/n^2) over the m rows of the size. Games as in `inner_frame`.
    """
    whole = whole_games(sampled, _slice_gaps, "game_id BIGINT, n INT, size INT, rows BIGINT, i INT, j INT, gap DOUBLE")
    sampled = _rest(sampled)
    counts = strata_counts(sampled)
    co = co_membership(sampled.withColumn("value", F.lit(0.0)), by_size=True).select("game_id", "size", "i", "j", F.col("count").alias("both"))
    left = counts.select("game_id", "size", "n", "rows", F.col("player").alias("i"), F.col("holding").alias("hold_i"),
                         F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    right = counts.select("game_id", "size", F.col("player").alias("j"), F.col("holding").alias("hold_j"))
    cells = left.join(large(right), ["game_id", "size", "j"]).join(large(co), ["game_id", "size", "i", "j"], "left").fillna(0, ["both"])
    n, s, m = F.col("n").cast("double"), F.col("size").cast("double"), F.col("rows").cast("double")
    operator = n / (s * (n - s)) * (F.col("both") / m - s / n * (F.col("hold_i") + F.col("hold_j")) / m + s * s / (n * n))
    target = (F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - 1 / n) / (n - 1)
    return cells.select("game_id", "n", "size", "rows", "i", "j", (operator - target).alias("gap")).unionByName(whole)


def _slice_gaps(ids, n, made):
    for (game, size), z, _, own in made(True):
        width, s = z.shape[2], size.astype(float)[:, None, None]
        rows, hold = (own > 0).sum(axis=1)[:, :, None], z.sum(axis=1)
        for tile in _tiles(z):
            both = z[:, :, tile].transpose(0, 2, 1) @ z
            operator = width / (s * (width - s)) * (both / rows - s / width * (hold[:, tile, None] + hold[:, None, :]) / rows + s * s / (width * width))
            at, i, j, gap = _cells(game, width, tile, operator - _target(width, tile) / (width - 1))
            yield ids[game][at], np.full(len(at), width), size[at], rows[:, 0, 0][at], i, j, gap


def slice_moments(sampled: DataFrame) -> DataFrame:
    """First and second moment error of every size."""
    second = slice_frames(sampled).groupBy("game_id", "size").agg(F.sum(F.col("gap") * F.col("gap")).alias("second_squared"))
    return slice_means(strata_counts(sampled)).join(large(second), ["game_id", "size"])


def moment_summary(moments: DataFrame) -> DataFrame:
    """Equal-size RMS, worst and row-weighted RMS of both moments; sizes that never occur are counted."""
    a, b, m = F.col("first_squared"), F.col("second_squared"), F.col("rows")
    return moments.groupBy("game_id").agg(
        (F.first("n") - 3).alias("expected_sizes"), F.count(F.lit(1)).alias("observed_sizes"),
        F.sqrt(F.avg(a)).alias("first_rms"), F.sqrt(F.avg(b)).alias("second_rms"),
        F.sqrt(F.max(a)).alias("first_worst"), F.sqrt(F.max(b)).alias("second_worst"),
        F.sqrt(F.sum(m * a) / F.sum(m)).alias("first_weighted"), F.sqrt(F.sum(m * b) / F.sum(m)).alias("second_weighted"))


def stratified_summary(frames: DataFrame) -> DataFrame:
    """Slice Frobenius RMS, root of summed squares and worst, and the discrepancy of the summed operators."""
    by_size = frames.groupBy("game_id", "size").agg(F.sum(F.col("gap") * F.col("gap")).alias("q"))
    slices = by_size.groupBy("game_id").agg(F.sqrt(F.avg("q")).alias("slice_rms"), F.sqrt(F.sum("q")).alias("root_sum_squares"),
                                            F.sqrt(F.max("q")).alias("slice_worst"))
    total = frames.groupBy("game_id", "i", "j").agg(F.sum("gap").alias("g")).groupBy("game_id").agg(
        F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("aggregate"))
    return slices.join(large(total), "game_id")


def orbit_signature(bases: DataFrame) -> DataFrame:
    """First row of the operator of a base's cyclic orbit: (N_k - s^2/n)/(s(n-s)), N_k = #{(a, b): b - a = k mod n}."""
    n, s = F.col("n").cast("double"), F.col("size").cast("double")
    rows = bases.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = F.size(F.array_intersect("members", F.transform("members", lambda a: (a + F.col("k")) % F.col("n"))))
    return rows.withColumn("signature", (met - s * s / n) / (s * (n - s)))


def coverage(counts: DataFrame) -> DataFrame:
    """Least in/out counts, missing strata over the 2n(n-3) cells, balanced and observed sizes, per game."""
    out = F.col("rows") - F.col("holding")
    sizes = counts.groupBy("game_id", "size").agg(
        F.first("n").alias("n"), F.min("holding").alias("lo"), F.max("holding").alias("hi"), F.min(out).alias("out_lo"),
        F.sum((F.col("holding") == 0).cast("bigint")).alias("no_in"), F.sum((out == 0).cast("bigint")).alias("no_out"))
    total = sizes.groupBy("game_id").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("observed_sizes"), F.min("lo").alias("_in"), F.min("out_lo").alias("_out"),
        F.sum((F.col("lo") == F.col("hi")).cast("bigint")).alias("balanced_sizes"), F.sum("no_in").alias("no_in"), F.sum("no_out").alias("no_out"))
    unseen = (F.col("n") - 3 - F.col("observed_sizes")) * F.col("n")
    whole = F.col("observed_sizes") == F.col("n") - 3
    return total.select(
        "game_id", "n", "observed_sizes", "balanced_sizes", F.when(whole, F.col("_in")).otherwise(0).alias("least_in"),
        F.when(whole, F.col("_out")).otherwise(0).alias("least_out"), (F.col("no_in") + unseen).alias("missing_in"),
        (F.col("no_out") + unseen).alias("missing_out"))


def missing_fraction(covered: DataFrame) -> DataFrame:
    cells = 2 * F.col("n") * (F.col("n") - 3)
    return covered.select("game_id", ((F.col("missing_in") + F.col("missing_out")) / cells).alias("missing_fraction"))


def imbalance(counts: DataFrame) -> DataFrame:
    """Deviation of in-counts from rows*s/n: worst, mean and relative, and the slice coefficients of variation."""
    goal = F.col("rows") * F.col("size") / F.col("n")
    rows = counts.withColumn("goal", goal).withColumn("gap", F.abs(F.col("holding") - goal))
    sizes = rows.groupBy("game_id", "size").agg(
        F.max("gap").alias("worst"), F.sum("gap").alias("total"), F.count(F.lit(1)).alias("cells"),
        (F.max("gap") / F.greatest(F.first("goal"), F.lit(1.0))).alias("relative"),
        (F.stddev_pop("holding") / F.greatest(F.first("goal"), F.lit(1.0))).alias("cv"))
    return sizes.groupBy("game_id").agg(
        F.max("worst").alias("worst_deviation"), (F.sum("total") / F.sum("cells")).alias("mean_deviation"),
        F.max("relative").alias("worst_relative"), F.avg("cv").alias("mean_cv"), F.max("cv").alias("worst_cv"))


def size_histogram(sampled: DataFrame) -> DataFrame:
    """Coalitions per size, counted on the row of player 0."""
    return sampled.where("player = 0").groupBy("game_id", "size").agg(F.count(F.lit(1)).alias("coalitions"))


def fingerprint(coalitions: DataFrame, bucket: int = 1024) -> DataFrame:
    """Order-sensitive hash of a design (game_id, sample, members): row hashes fold per bucket of samples, then per game."""
    row = F.md5(F.concat_ws("|", F.col("sample").cast("string"), F.concat_ws(",", F.transform("members", lambda m: m.cast("string")))))
    rows = coalitions.select("game_id", "sample", F.floor(F.col("sample") / bucket).alias("part"), row.alias("h"))
    fold = lambda key: F.md5(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(key, "h"))), lambda e: e["h"])))
    parts = rows.groupBy("game_id", "part").agg(fold("sample").alias("h"))
    return parts.groupBy("game_id").agg(fold("part").alias("fingerprint"))
