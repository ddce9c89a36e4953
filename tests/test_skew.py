"""The two-level paths of hot games give the same answers as plain windows."""

import pytest

from allotment.catalog import ORACLES, QUERIES
from check import compare
from conftest import FOLDER

NAMES = ["order_cost_exact", "customer_cost_exact", "full_permutation_mean", "order_cost_paths", "coupled_linear", "ratio_zero_filled",
         "stratified_linear", "complementary", "group_testing", "gels", "truncated_permutation_mean", "antithetic_mean", "boundary_values",
         "majority_values", "efficiency_projection", "rank_correlation", "stratified_split", "round_robin_split", "timing_summary",
         "reference_quantiles", "design_error_correlation", "systematic_sizes", "power_index"]


@pytest.mark.parametrize("name", NAMES)
def test_hot_games(spark, con, conf, name):
    conf("spark.allotment.hotRows", 9)
    assert compare(QUERIES[name](spark, FOLDER), ORACLES[name], con) == "ok"


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("name", ["coupled_linear", "greedy_per_size_design", "orthogonal_permutations", "full_permutation_mean"])
def test_result_does_not_depend_on_partitions(spark, conf, name, partitions):
    rows = lambda: sorted(map(tuple, QUERIES[name](spark, FOLDER).collect()))
    expected = rows()
    conf("spark.sql.shuffle.partitions", partitions)
    assert rows() == expected


@pytest.mark.parametrize("hot", [7, 10**6])
def test_marginal_counts_in_buckets(spark, conf, con, hot):
    conf("spark.allotment.hotRows", hot)
    assert compare(QUERIES["plan_marginal_counts"](spark, FOLDER), ORACLES["plan_marginal_counts"], con) == "ok"


def test_mean_cost_of_a_large_game(spark):
    """400 players with 100 costs against exact binomials."""
    from fractions import Fraction
    from math import comb
    from allotment.operators.exact import mean_cost_by_size
    costs = sorted(3 * (p % 100) + 2 for p in range(400))
    got = {r.size: r.mean_value for r in mean_cost_by_size(spark.createDataFrame([(5, c) for c in costs], "game_id long, cost long")).collect()}
    for s in (1, 2, 7, 150, 399, 400):
        exact = Fraction(sum(c * comb(i, s - 1) for i, c in enumerate(costs)), comb(400, s))
        assert abs(got[s] - float(exact)) < 1e-9 * float(exact)
    assert len(got) == 400
