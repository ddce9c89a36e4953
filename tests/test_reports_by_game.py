"""Reports of results are dealt out by game once, before they become rows of methods and budgets."""

import pytest

from allotment.catalog import QUERIES
from allotment.operators import analytics as A
from conftest import FOLDER


@pytest.mark.parametrize("name", ["rank_correlation", "top_overlap", "estimate_bias", "relative_errors"])
def test_cells_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "player#" in line and "budget_index#" in line]
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "repeat#" in line and "budget_index#" in line]


def _scored(spark):
    rows = [(g, m, r, 0, p, float((p * 7 + r * g) % 4), float(p * 5 % 3)) for g, n in ((1, 1), (2, 3), (3, 9)) for m in "ab" for r in range(2) for p in range(n)]
    return spark.createDataFrame(rows, "game_id BIGINT, method STRING, repeat INT, budget_index INT, player INT, value DOUBLE, truth DOUBLE")


@pytest.mark.parametrize("report", [A.rank_correlation, A.top_overlap])
def test_large_and_small_games_agree(spark, report):
    rows = _scored(spark)
    assert sorted(report(rows, wide=True).collect()) == sorted(report(rows, wide=False).collect())


def test_ranks_take_one_sort(spark):
    ranked = _scored(spark).withColumn("rank", A.average_rank("value", A.CELL))
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    got = {(r.player, r.value): r["rank"] for r in ranked.where("game_id = 3 and method = 'a' and repeat = 0").collect()}
    values = sorted(v for _, v in got)
    assert all(r == values.index(v) + (values.count(v) + 1) / 2 for (_, v), r in got.items())
