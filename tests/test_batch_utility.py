"""Utilities of whole coalitions in every method, and calls that stop with truncated paths."""

import numpy as np
import pandas as pd
import pytest
from test_methods import players

from allotment.attribute import BASELINES, DESIGN_MODES, attribute, budgeted
from allotment.operators import utilities as U
from allotment.operators.skew import Split

COST = [3, 1, 4, 1, 5, 9]


def dearest_member():
    """Made in a function, so that it goes to workers by value."""
    return lambda batch: batch["cost"].map(lambda c: float(max(c, default=0)))


dearest = dearest_member()


@pytest.mark.parametrize("method", DESIGN_MODES + BASELINES)
def test_same_shares_as_the_folded_utility(spark, method):
    """The same game, folded member by member and valued as whole coalitions."""
    p = players(spark, cost=COST)
    kw = dict(per_player=6, seed="u", pool=4, patience=0)
    folded = [r.share for r in attribute(p, U.max_cost(), method, **kw).orderBy("player").collect()]
    whole = [r.share for r in attribute(p, U.BatchUtility("dearest", dearest, ("cost",)), method, **kw).orderBy("player").collect()]
    assert whole == pytest.approx(folded)


def counting(folder):
    """A utility that leaves a line per coalition it values."""
    def call(batch):
        import uuid
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write("".join(f"{len(m)}\n" for m in batch["members"]))
        return batch["members"].map(lambda m: min(len(m), 3) / 3)
    return call


def calls_of(folder):
    return sum(len(f.read_text().splitlines()) for f in folder.iterdir())


def test_truncation_saves_calls(spark, tmp_path):
    """v reaches v(all) with three members, so a path ends after four of its twelve (patience 1)."""
    p = players(spark, cost=list(range(12)))
    counted = {}
    for method in ("permutation", "truncated"):
        folder = tmp_path / method
        folder.mkdir()
        utility = U.BatchUtility("few", counting(str(folder)))
        got = budgeted(p, utility, method, 242, "s", patience=1)
        shares = [r.share for r in got.shares.orderBy("player").collect()]
        got.runs.collect()
        counted[method] = calls_of(folder)
        assert sum(shares) == pytest.approx(1.0)
    assert counted["permutation"] == 26 + 21 * 11  # the whole boundary, which paths do not need but carry, and 21 paths
    assert counted["truncated"] == 26 + 20 * 4
    run = budgeted(p, U.BatchUtility("few", counting(str(tmp_path))), "truncated", 242, "s", patience=1).runs.first()
    assert (run.units, run.actual_calls) == (20, 82)


def test_truncated_paths_agree_with_masked_ones(spark):
    """Place by place or all prefixes and then a mask: the same stops and marginals."""
    from allotment.operators import designs as D
    from allotment.operators import estimators as E
    from allotment.operators.custom import evaluate_paths
    split = U.boundary(Split(players(spark, cost=COST)), U.max_cost())
    orders = D.random_order(split, 25, "m")
    masked = E.truncate_paths(U.path_values(orders, U.max_cost()), 0.2, True, 1).rows()
    walked = evaluate_paths(orders, U.BatchUtility("dearest", dearest, ("cost",)), 0.2, True, 1).rows()
    columns = ["sample", "pos", "player", "stop", "evaluated", "marginal"]
    assert sorted(map(tuple, walked.select(*columns).fillna(-1, ["stop"]).collect())) == sorted(map(tuple, masked.select(*columns).fillna(-1, ["stop"]).collect()))


def test_bad_values_stop_the_job(spark):
    p = players(spark, cost=COST)
    for call in (lambda b: pd.Series([np.nan] * len(b)), lambda b: pd.Series([1.0])):
        with pytest.raises(Exception, match="finite|one value"):
            attribute(p, U.BatchUtility("bad", call), "iid", 4).collect()
