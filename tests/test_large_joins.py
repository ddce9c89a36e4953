"""Joins of tables that both grow with the games are never planned as broadcasts, however small their files look."""

import pytest

from allotment.catalog import QUERIES
from conftest import FOLDER


@pytest.mark.parametrize("name", [
    "all_permutations_mean", "attribute_complete_orbits", "attribute_coupled", "attribute_greedy_by_size", "attribute_orbit", "attribute_stratified",
    "estimate_bias", "estimate_cells", "frame_discrepancy", "greedy_design_discrepancy"])
def test_no_broadcast(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
    assert "SortMergeJoin" in plan


def test_cell_reports_do_not_broadcast(spark, monkeypatch):
    from allotment.catalog import results
    seen = []
    monkeypatch.setattr(results, "cut", lambda df, name="": seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    for name in ("bootstrap_change", "bootstrap_rmse", "comparison_table", "configuration_ranking", "design_error_correlation", "efficiency_gap",
                 "error_trend", "geometric_mean_ratio"):
        seen.append(QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString())
    assert not [plan for plan in seen if "BroadcastHashJoin" in plan]


def below_exchanges(plan):
    """Expressions of every Generate that has an Exchange above it in a plan printed as a tree."""
    found, open_ = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        open_ = [d for d in open_ if d < depth]
        if " Exchange " in line or line.lstrip(" :+-").startswith("Exchange "):
            open_.append(depth)
        elif "Generate " in line and open_:
            found.append(line.strip())
    return found


def test_predecessors_are_not_shuffled(spark):
    for name in ("stratified_marginal_mean", "predecessor_samples"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "predecessors" not in "".join(below_exchanges(plan)) and "other_cost" not in plan


def test_coalition_rows_are_multiplied_after_the_shuffle(spark, conf):
    from allotment.operators import balanced as G
    conf("spark.sql.autoBroadcastJoinThreshold", -1)
    players = spark.createDataFrame([(g, i, 3, 10 * g + i) for g in (1, 2) for i in (2, 0, 1)], "game_id BIGINT, player INT, n INT, cost BIGINT")
    design = spark.createDataFrame([(1, "d", 0, 1, 3, [1]), (2, "d", 5, 2, 3, [0, 2]), (3, "d", 6, 1, 3, [0])],
                                   "game_id BIGINT, design STRING, sample BIGINT, size INT, n INT, members ARRAY<INT>")
    rows = G.sampled_rows(design, players)
    assert {(r.game_id, r.sample, r.player, r.inside, r.cost, r.n, r.block) for r in rows.collect()} == {
        (1, 0, 0, False, 10, 3, 0), (1, 0, 1, True, 11, 3, 0), (1, 0, 2, False, 12, 3, 0),
        (2, 5, 0, True, 20, 3, 0), (2, 5, 1, False, 21, 3, 0), (2, 5, 2, True, 22, 3, 0)}
    assert not below_exchanges(rows._jdf.queryExecution().executedPlan().toString())


def test_path_rows_are_not_shuffled(spark, conf):
    """Orders in arrays take along their players: values along the paths need no shuffle of path rows."""
    from pyspark.sql import functions as F

    from allotment.operators import designs as D
    from allotment.operators import utilities as U
    from allotment.operators.skew import Split
    conf("spark.sql.autoBroadcastJoinThreshold", -1)
    players = spark.createDataFrame([(g, i, n, 10 * (g or 0) + i) for g, n in ((1, 3), (2, 4), (None, 2)) for i in range(n)], "game_id BIGINT, player INT, n INT, cost BIGINT")
    games = D.with_own(players.where("player = 0").select("game_id", "n"), players)
    pairs = D.with_own(games.select("game_id", "n", (F.col("n") - 3).alias("pair"), F.sequence(F.lit(0), F.col("n") - 1).alias("players")), players)
    for orders, each in ((D.component_array(games, 2, "c"), {1: 12, 2: 24}), (D.latin_square(games, 2, "l"), {1: 6, 2: 8}),
                         (D.all_orders(games), {1: 6, 2: 24}), (D.reverse_pairs(pairs), {1: 2, 2: 2})):
        paths = U.path_values(Split(orders), U.max_cost()).rows()
        assert "inline(" not in "".join(below_exchanges(paths._jdf.queryExecution().executedPlan().toString()))
        rows = paths.collect()
        assert all(r.cost == 10 * r.game_id + r.player for r in rows)
        for g, count in each.items():
            of = {}
            for r in rows:
                if r.game_id == g:
                    of.setdefault((r.block, r.sample), []).append((r.pos, r.player))
            assert len(of) == count and {r.game_id for r in rows} == set(each)
            for path in of.values():
                assert sorted(p for p, _ in path) == list(range(1, g + 3)) and sorted(i for _, i in path) == list(range(g + 2))
