"""Stratified differential estimate with a call cap: cover every ordered pair at every size first, then sample.

A game's calls go to the two ends, to partitions of its players at every size with their complements, to the
coalitions that fill the pairs still missing (with complements), and what is left to coalitions of sizes from the
kernel law. Games are independent, and every table has one row per coalition until players are attached.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allotment.functions.hashing import first_in_order, uniform
from allotment.functions.laws import KERNEL
from allotment.operators import balanced as G
from allotment.operators import designs as D
from allotment.operators import pairs as P
from allotment.operators.skew import Split, large
from allotment.operators.utilities import BatchUtility, Utility, evaluate
from allotment.sources.shared import cut

DESIGN = ["game_id", "design", "n", "sample", "size", "members"]
#: Player rows that one co-membership product takes at a time.
PACK_ROWS = 2**18


def covering_rows(games: DataFrame, seed: str) -> DataFrame:
    """Partitions, fills and their complements: every ordered pair (i in, j out) occurs at every size.

    Samples are numbered below zero by size, kind, part and side, so random samples can count from zero.
    """
    parts = D.partition_blocks(games, seed)
    fills = G.fill_pairs(parts.where("complement = 0").select("game_id", "n", F.col("base_size").alias("size"), "members"), seed)
    rest = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("members"))
    sides = F.array(F.struct(F.lit(0).alias("complement"), F.col("members")), F.struct(F.lit(1).alias("complement"), rest.alias("members")))
    fills = fills.select("game_id", "n", F.col("size").alias("base_size"), F.col("sample").alias("part"), F.inline(sides))
    both = parts.select("game_id", "n", "base_size", F.col("part").cast("bigint").alias("part"), "complement", "members", F.lit(0).alias("fill"))
    both = both.unionByName(fills.withColumn("fill", F.lit(1)))
    number = ((F.col("base_size").cast("bigint") * 2 + F.col("fill")) * 2**24 + F.col("part")) * 2 + F.col("complement")
    return both.select("game_id", F.lit("covering").alias("design"), "n", (-1 - number).alias("sample"),
                       F.size("members").alias("size"), "members")


def plan(games: DataFrame, covering: DataFrame, calls: Column) -> DataFrame:
    """Calls of every game: target, covering and random ones, and whether the cap pays for the method.

    It does not where fewer than ceil(4 n ln n) calls are left beside the two ends, where the covering rows alone
    cost more, or with fewer than two players: status 'budget_infeasible', and no call is made.
    """
    counts = covering.groupBy("game_id").agg(F.count(F.lit(1)).alias("covering_calls"))
    rows = games.select("game_id", "n", calls.cast("bigint").alias("target_calls")).join(large(counts), "game_id", "left").fillna(0, ["covering_calls"])
    left = F.col("target_calls") - 2
    least = F.ceil(4 * F.col("n") * F.log(F.col("n").cast("double")))
    fits = (F.col("n") >= 2) & (left >= 1) & (left >= least) & (left >= F.col("covering_calls"))
    return rows.select("game_id", "n", "target_calls", F.when(fits, F.col("covering_calls")).otherwise(0).alias("covering_calls"),
                       F.when(fits, left - F.col("covering_calls")).otherwise(0).alias("random_calls"),
                       F.when(fits, F.col("target_calls")).otherwise(0).alias("calls"),
                       F.when(fits, "ok").otherwise("budget_infeasible").alias("status"))


def random_rows(runs: DataFrame, seed: str) -> DataFrame:
    """Coalitions of the random phase: sizes from the kernel law, members uniform."""
    rows = runs.where("random_calls > 0").withColumn("sample", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("random_calls") - 1)))
    rows = rows.withColumn("n", F.col("n").cast("int")).repartition(D.shuffle_partitions(), "game_id", "sample")
    size = KERNEL.draw(uniform(seed, F.lit("size"), F.col("game_id"), F.col("sample")), F.col("n"))

    def members(batches):
        for batch in batches:
            games, samples = (batch.column(c).to_pylist() for c in ("game_id", "sample"))
            n, sizes = (batch.column(c).to_numpy() for c in ("n", "size"))
            listed = first_in_order([(seed, "rows", *names) for names in zip(games, samples)], n, sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], [*batch.schema.names, "members"])

    sized = rows.select("game_id", F.lit("random").alias("design"), "n", "sample", size.cast("int").alias("size"))
    return sized.mapInArrow(members, "game_id BIGINT, design STRING, n INT, sample BIGINT, size INT, members ARRAY<INT>")


def estimate(players: DataFrame, utility: Utility | BatchUtility, calls: Column, seed: str) -> tuple[DataFrame, DataFrame]:
    """(shares, runs). Shares are (game_id, player, share, status), null where the status is not 'ok'.

    `players` has game_id, player, n, the utility's columns and the endpoints; `calls` is the cap of a game.
    """
    games = players.where("player = 0").select("game_id", "n")
    covering = cut(covering_rows(games, seed), "covering")
    runs = cut(plan(games, covering, calls), "plan")
    design = covering.select(*DESIGN).unionByName(random_rows(runs, seed))
    rows = None
    # Coalitions of a game that are few enough for a task are valued in their row and summed there; the others in blocks.
    fits = F.col("calls") * F.col("n") <= PACK_ROWS
    paid = runs.where("status = 'ok'")
    if isinstance(utility, BatchUtility) or not paid.where(~fits).isEmpty():
        wide = paid if isinstance(utility, BatchUtility) else paid.where(~fits)
        some = design.join(large(wide.select("game_id")), "game_id").select(*DESIGN)
        rows = G.sampled_rows(some, players).withColumn("block", F.floor(F.col("sample") * F.col("n") / PACK_ROWS))
        rows = rows.withColumn("block", F.when(F.col("block") < 0, F.col("block") - 1).otherwise(F.col("block")))
        rows = evaluate(Split(rows), utility).rows().select("game_id", "n", "block", "sample", "size", "player", "inside", "value")
    if isinstance(utility, BatchUtility):
        sums = P.swing_sums(rows, by_size=True)
    else:
        valued = G.valued_rows(design, players.join(large(paid.where(fits).select("game_id")), "game_id"), utility)
        sums = P.swing_sums(valued.withColumn("block", F.lit(D.WHOLE)), by_size=True)
        sums = sums if rows is None else sums.unionByName(P.swing_sums(rows, by_size=True))
    shares = P.differential_shares(sums, players, by_size=True).join(large(runs.select("game_id", "status")), "game_id")
    share = F.when(F.col("status") == "ok", F.col("share"))
    return shares.select("game_id", "player", share.alias("share"), "status"), runs
