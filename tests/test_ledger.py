"""Calls under a cap: what is planned, what is counted, and no share that is missing without a word."""

import pytest
from pyspark.sql import functions as F
from test_methods import players

from allotment.attribute import BASELINES, DESIGN_MODES, attribute, budgeted
from allotment.operators import utilities as U
from allotment.plans import ledger as L


@pytest.fixture(scope="module")
def three(spark):
    """Games of one, five and nine players."""
    rows = [(g, i, n, 10 * i % 7 + g) for g, n in ((1, 1), (5, 5), (9, 9)) for i in range(n)]
    return spark.createDataFrame(rows, "game_id BIGINT, player INT, n INT, cost BIGINT").cache()


@pytest.mark.parametrize("method", DESIGN_MODES + BASELINES)
@pytest.mark.parametrize("calls", [1, 40, 100])
def test_no_game_calls_more_than_its_cap(three, method, calls):
    got = budgeted(three, U.max_cost(), method, calls, "c", pool=4)
    runs = {r.game_id: r for r in got.runs.collect()}
    shares = got.shares.collect()
    assert set(runs) == {1, 5, 9} and len(shares) == 15
    for r in runs.values():
        assert 0 <= r.actual_calls <= calls == r.target_calls and r.unused_calls == calls - r.actual_calls
        assert (r.actual_calls == 0) == (r.status != L.OK)
    for s in shares:
        assert (s.share is None) == (s.status != L.OK)
        assert s.status == runs[s.game_id].status or (s.status, runs[s.game_id].status) == (L.UNCOVERED, L.OK)
    if calls == 1:
        assert all(r.status != L.OK for r in runs.values())


def test_a_cap_of_its_own_for_every_game(three):
    runs = budgeted(three, U.max_cost(), "permutation", F.col("n") * 10, "c").runs.orderBy("game_id").collect()
    assert [(r.target_calls, r.units, r.actual_calls) for r in runs] == [(10, 1, 2), (50, 12, 50), (90, 11, 90)]


def test_truncated_paths_leave_calls_unused(three):
    run = budgeted(three, U.max_cost(), "truncated", 92, "c", patience=0).runs.where("game_id = 9").first()
    assert run.units == 10 and run.actual_calls < 92


def test_balanced_counts(spark):
    p = players(spark, cost=[1, 5, 2, 8, 3, 7])
    whole = attribute(p, U.max_cost(), "complete_orbits", 3, "b", missing="balanced").collect()
    assert len(whole) == 6 and all(r.share is not None for r in whole)
    with pytest.raises(Exception, match="unseen strata"):
        attribute(p, U.max_cost(), "iid", 3, "b", missing="balanced").collect()
    assert {r.status for r in budgeted(p, U.max_cost(), "iid", 40, "b", missing="balanced").shares.collect()} == {L.UNCOVERED}


def test_stratified_marginals_of_all_cells(spark):
    """A sum of parts has the same marginal everywhere; a majority's marginals average to its index when all cells are seen."""
    coef = [0.5, -1.0, 2.0, 3.5]
    got = attribute(players(spark, coef=coef), U.additive("coef", 7.0), "stratified_marginal", 2, "m").orderBy("player").collect()
    assert [r.share for r in got] == pytest.approx(coef)
    p = players(spark, weight=[2, 1, 1], quota=[3, 3, 3])
    got = attribute(p, U.weighted_majority(), "stratified_marginal", 200, "m").orderBy("player").collect()
    assert [r.share for r in got] == pytest.approx([2 / 3, 1 / 6, 1 / 6], abs=0.06)


def test_missing_pairs_are_never_silent(spark):
    with pytest.raises(Exception, match="unseen strata"):
        attribute(players(spark, cost=[1, 2, 3, 4, 5, 6, 7, 8]), U.max_cost(), "differential", 1, "d").collect()
    got = attribute(players(spark, cost=[1, 2, 3, 4, 5]), U.max_cost(), "stratified_differential", 1, "d").collect()
    assert all(r.share is not None for r in got)


def test_unknown_methods_have_no_price():
    with pytest.raises(ValueError):
        L.price("nothing", F.lit(3))


@pytest.mark.parametrize("n", [65, 81, 125, 128])
def test_component_arrays_of_large_fields(spark, n):
    """Every row is a permutation; over a whole field every ordered pair of players stands once in some pairs of columns."""
    from allotment.operators import designs as D
    rows = D.component_array(spark.createDataFrame([(1, n)], "game_id BIGINT, n INT"), 1, "c")
    q = {65: 67}.get(n, n)
    at = rows.groupBy("sample").agg(F.count("*").alias("c"), F.countDistinct("player").alias("d"), F.max("pos").alias("m")).agg(
        F.count("*"), F.min("c"), F.min("d"), F.max("m")).first()
    assert tuple(at) == (q * (q - 1), n, n, n)
    if q == n:
        pick = lambda k: F.max(F.when(F.col("pos") == k, F.col("player")))
        wide = rows.where(F.col("pos").isin(1, 2, n // 2, n)).groupBy("sample").agg(*[pick(k).alias(f"c{i}") for i, k in enumerate((1, 2, n // 2, n))])
        for a, b in ((0, 1), (1, 2), (0, 3), (2, 3)):
            assert wide.select(f"c{a}", f"c{b}").distinct().count() == n * (n - 1)


def test_games_beyond_the_largest_field(spark):
    big = spark.createDataFrame([(1, i, 5000, 1) for i in range(5000)], "game_id BIGINT, player INT, n INT, cost BIGINT")
    runs = budgeted(big, U.max_cost(), "component_array", 1 << 40, "c").runs.collect()
    assert [(r.status, r.actual_calls) for r in runs] == [(L.INFEASIBLE, 0)]
