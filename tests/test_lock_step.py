import numpy as np

from allotment.operators import balanced as G


def _generators(count):
    return [G.generator("lock", at) for at in range(count)]


def _alone(n, sizes, rng, pool, balance, reuse=False):
    (rows,), control = G.lock_step(n, [sizes], [rng], pool, balance, reuse)
    return rows, control


def test_slices_in_lock_step_pick_what_they_pick_alone():
    n, weights = 15, [0.5, 0.1, 2.0, 0.1, 0.1]
    sizes = [np.array(s) for s in ([7] * 6, [1] * 20, [4] * 3, [14], [7] * 9)]  # drawn at random, started over, of different lengths
    for scope in ("size", "all"):
        plans = sizes if scope == "size" else [np.array([2, 7, 7, 13, 2, 5, 7][at:]) for at in range(5)]
        together, _ = G.lock_step(n, plans, _generators(5), 16, G.PairBalance(n, weights, 1.0, scope))
        for at, rng in enumerate(_generators(5)):
            rows, _ = _alone(n, plans[at], rng, 16, G.PairBalance(n, [weights[at]], 1.0, scope))
            assert np.array_equal(together[at], rows) and np.array_equal(rows.sum(axis=1), plans[at])
    chosen, control = G.lock_step(n, sizes, _generators(5), 4, G.ShiftBalance(n, 5, True), reuse=True)
    for at, rng in enumerate(_generators(5)):
        rows, (random,) = _alone(n, sizes[at], rng, 4, G.ShiftBalance(n, 1, True), reuse=True)
        assert np.array_equal(chosen[at], rows) and np.array_equal(control[at], random)


def test_slices_are_scored_together():
    """As many scoring steps as the longest slice has rows, not as all slices have."""
    calls = []

    class Counted(G.PairBalance):
        def score(self, at, s, z):
            calls.append(len(at))
            return super().score(at, s, z)

    G.lock_step(8, [np.full(5, 4)] * 50, _generators(50), 16, Counted(8, [0.1] * 50, 1.0, "size"))
    assert calls == [50] * 5


def test_null_games_keep_their_slices(spark):
    from pyspark.sql import functions as F
    games = spark.createDataFrame([(1, 5), (None, 6), (3, 6)], "game_id BIGINT, n INT")
    rows = G.stratified_design(games, F.col("n") * 3, "s").collect()
    assert {(g, sum(r.game_id == g for r in rows)) for g in (1, None, 3)} == {(1, 15), (None, 18), (3, 18)}
    assert all(len(r.members) == r.size and r.members == sorted(set(r.members)) and r.members[-1] < r.n for r in rows)
