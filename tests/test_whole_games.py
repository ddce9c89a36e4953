"""Games whose samples are in one block are finished in their task, with the numbers of games in several blocks."""

import pytest
from pyspark.sql import functions as F

from allotment.functions.laws import INNER, KERNEL
from allotment.operators import balanced as G
from allotment.operators import designs as D
from allotment.operators import geometry as Y
from allotment.operators import pairs as P
from allotment.operators import utilities as U
from allotment.operators.skew import Split


def _players(spark, *sizes):
    rows = spark.createDataFrame(list(enumerate(sizes, 1)), "game_id BIGINT, n INT")
    rows = rows.withColumn("player", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("cost", (F.col("player") * 7 + F.col("game_id")) % 5)
    return U.boundary(Split(rows.withColumn("weight", F.col("cost")).withColumn("quota", F.lit(9))), U.max_cost())


def _close(a, b, *keys):
    a, b = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys() and len(a) > 0
    for k, r in a.items():
        for c in r.__fields__:
            assert r[c] == pytest.approx(b[k][c], abs=1e-9), (k, c)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("make, keys", [(Y.slice_frames, ("game_id", "size", "i", "j")), (Y.inner_frame, ("game_id", "i", "j")),
                                        (Y.slice_moments, ("game_id", "size")), (Y.strata_counts, ("game_id", "size", "player"))])
def test_frames_of_whole_games(spark, monkeypatch, make, keys):
    players = _players(spark, 4, 9, 5, 30)
    in_blocks = lambda: D.iid_design(players, 24, "w", INNER).rows()
    whole = in_blocks()
    assert {r.block for r in whole.select("block").distinct().collect()} == {D.WHOLE}
    got = make(whole).localCheckpoint()
    monkeypatch.setattr(D, "SAMPLE_ROWS", 60)
    assert {r.block < 0 for r in in_blocks().select("block").distinct().collect()} == {False}
    _close(got, make(in_blocks()), *keys)


@pytest.mark.parametrize("make, exchanges", [(Y.slice_frames, 1), (Y.inner_frame, 1), (P.swing_sums, 2)])  # one that deals out games, one of no rows
def test_pairs_of_whole_games_are_not_shuffled(spark, make, exchanges):
    sampled = U.evaluate(D.iid_design(_players(spark, 4, 9), 8, "w", INNER), U.max_cost()).rows().localCheckpoint()
    assert _exchanges(make(sampled.withColumn("block", F.lit(D.WHOLE)))) == exchanges


@pytest.mark.parametrize("by_size", [False, True])
def test_differential_of_whole_games(spark, monkeypatch, by_size):
    players = _players(spark, 2, 3, 6, 40)
    shares = lambda: P.differential(U.evaluate(D.iid_design(players, 90, "w", KERNEL), U.max_cost()).rows(), players.rows(), by_size)
    got = shares().localCheckpoint()
    monkeypatch.setattr(D, "SAMPLE_ROWS", 60)
    _close(got, shares(), "game_id", "player")


def test_games_that_span_arrow_batches(spark, conf, monkeypatch):
    players = _players(spark, *range(4, 16))
    sampled = U.evaluate(D.iid_design(players, 24, "w", INNER), U.max_cost()).rows().localCheckpoint()
    got = P.swing_sums(sampled).localCheckpoint()
    monkeypatch.setattr(P, "MEMBERS", 50)
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    _close(got, P.swing_sums(sampled), "game_id", "player")


@pytest.mark.parametrize("utility", [U.max_cost(), U.weighted_majority(), U.additive("cost", 3.0)])
def test_values_folded_in_rows(spark, utility):
    players = _players(spark, 4, 9).rows()
    games = players.where("player = 0").select("game_id", "n")
    bases = games.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("size")).withColumn("members", F.sequence(F.lit(0), F.col("size") - 1))
    design = D.cyclic_orbit(bases).select("game_id", F.lit("d").alias("design"), "n", (F.col("size") * 100 + F.col("shift")).cast("bigint").alias("sample"), "size", "members")
    long = U.evaluate(Split(G.sampled_rows(design, players)), utility).rows().where("player = 0").select("game_id", "sample", "n", "value")
    _close(G.valued_rows(design, players, utility).select("game_id", "sample", "n", "value"), long, "game_id", "sample")
