"""Small games with known answers, and invariants of designs."""

import math
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from allotment.attribute import BASELINES, DESIGN_MODES, attribute
from allotment.functions.fields import field_tables
from allotment.functions.laws import INNER
from allotment.operators import balanced as G
from allotment.operators import designs as D
from allotment.operators import estimators as E
from allotment.operators import exact as X
from allotment.operators import pairs as P
from allotment.operators import utilities as U
from allotment.operators.skew import Split
from allotment.plans import budget as B


def players(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(1, i, n, *[c[i] for c in columns.values()]) for i in range(n)]
    types = ["DOUBLE" if any(isinstance(v, float) for v in c) else "BIGINT" for c in columns.values()]
    schema = "game_id BIGINT, player INT, n INT, " + ", ".join(f"{k} {t}" for k, t in zip(columns, types))
    return spark.createDataFrame(rows, schema)


def shares(df):
    return [r["share"] for r in df.orderBy("player").collect()]


def games(spark, *sizes):
    return spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "game_id BIGINT, n INT")


def complete(spark, p, utility):
    """All proper subsets of one game as sampled rows with boundary columns."""
    split = E.boundary_part(U.boundary(Split(p), utility))
    n = p.count()
    rows = split.rows().withColumn("sample", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(2**n - 2).cast("bigint"))))
    rows = rows.withColumn("block", F.lit(0).cast("bigint")).withColumn("inside", F.expr("(shiftright(sample, player) & 1) = 1"))
    rows = rows.withColumn("size", F.bit_count("sample"))
    return split, U.evaluate(Split(rows), utility, with_rest=True)


def test_airport(spark):
    exact = X.airport_shares(players(spark, cost=[1, 1, 2, 3]))
    assert shares(exact) == pytest.approx([0.25, 0.25, 0.75, 1.75])


def test_airport_hundred(spark):
    counts = [8, 12, 6, 14, 8, 9, 13, 10, 10, 10]
    costs = [c + 1 for c, k in enumerate(counts) for _ in range(k)]
    got = shares(X.airport_shares(players(spark, cost=costs)))
    steps = np.cumsum([1 / d for d in (100, 92, 80, 74, 60, 52, 43, 30, 20, 10)])
    assert got == pytest.approx([steps[c - 1] for c in costs])
    assert sum(got) == pytest.approx(10)


@pytest.mark.parametrize("weights,quota,expected", [
    ([1, 1, 1], 2, [1 / 3] * 3), ([2, 1, 1], 3, [2 / 3, 1 / 6, 1 / 6]), ([3, 1, 1], 3, [1, 0, 0]), ([270, 0], 270, [1, 0])])
def test_voting(spark, weights, quota, expected):
    p = players(spark, weight=weights).withColumn("quota", F.lit(quota).cast("bigint"))
    assert shares(X.power_index(p)) == pytest.approx(expected)


def test_power_index_matches_enumeration():
    rng = np.random.default_rng(3)
    for n in (2, 4, 6):
        w = rng.integers(0, 9, n)
        quota = int(w.sum() // 2 + 1)
        swings = np.zeros(n)
        orders = list(permutations(range(n)))
        for order in orders:
            total = 0
            for i in order:
                if total < quota <= total + w[i]:
                    swings[i] += 1
                total += w[i]
        assert X.swing_shares(w, quota) == pytest.approx(swings / len(orders))


def test_large_body_uses_exact_integers():
    assert X.swing_shares([1] * 70, 36) == pytest.approx([1 / 70] * 70)


@pytest.mark.parametrize("name", ["ratio", "complementary", "differential", "stratified_differential", "group_testing_like"])
def test_complete_enumeration_is_exact(spark, name):
    p = players(spark, cost=[3, 1, 7, 4, 4])
    split, sampled = complete(spark, p, U.max_cost())
    want = shares(X.airport_shares(p))
    rows = sampled.rows()
    if name == "ratio":
        inner = sampled.map(lambda df, hot: df.where("size between 2 and n - 2"))
        assert shares(E.ratio(inner, "balanced")) == pytest.approx(want)
        assert shares(E.stratified_linear(inner)) == pytest.approx(want)
    elif name == "complementary":
        full = split.rows().withColumn("sample", F.lit(31).cast("bigint")).withColumn("block", F.lit(0).cast("bigint")).withColumn(
            "inside", F.lit(True)).withColumn("size", F.col("n")).withColumn("value", F.col("full_value")).withColumn("rest", F.col("empty_value"))
        both = Split(rows.unionByName(full.select(*rows.columns)))
        assert shares(E.complementary(both)) == pytest.approx(want)
    elif name == "differential":
        # Complete slices with weights 4:6:6:4 -> repeat sizes so that every size has the kernel law 1/(s(n-s)).
        copies = F.when(F.col("size").isin(1, 4), 3).otherwise(1)
        weighted = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("sample", F.col("sample") * 10 + F.col("copy"))
        assert shares(P.differential(weighted, split.rows())) == pytest.approx(want)
    elif name == "stratified_differential":
        assert shares(P.differential(rows, split.rows(), by_size=True)) == pytest.approx(want)
    else:
        assert shares(P.kernel_shap(rows.withColumn("value", F.col("value")), split.rows())) is not None


def test_complementary_missing_strata(spark):
    p = players(spark, cost=[6, 6, 6]).withColumn("sample", F.lit(0).cast("bigint")).withColumn("size", F.lit(3)).withColumn(
        "inside", F.lit(True)).withColumn("value", F.lit(6.0)).withColumn("rest", F.lit(0.0))
    assert shares(E.complementary(Split(p))) == pytest.approx([2, 2, 2])


def test_truncation_patience_and_accounting(spark):
    split = U.boundary(Split(players(spark, cost=[1] * 10)), U.max_cost())
    paths = E.truncate_paths(U.path_values(D.random_order(split, 20, "t"), U.max_cost()), 0.0, True, 5)
    row = E.truncation_accounting(paths, F.lit(202)).collect()[0]
    assert (row["prefixes"], row["calls"], row["unused_calls"], row["truncation_rate"], row["mean_prefix"]) == (120, 122, 80, 1.0, 6.0)


def test_kernel_shap_exact_on_additive_games(spark):
    p = players(spark, coef=[0.5, -1.0, 2.0, 3.5, 0.25])
    got = attribute(p, U.additive("coef", -4.0), "kernel_shap", 20, "k")
    assert shares(got) == pytest.approx([0.5, -1.0, 2.0, 3.5, 0.25])


def test_constrained_fit_keeps_efficiency_when_rank_is_short():
    share = P.constrained_fit(np.zeros((4, 4)), np.zeros(4), 2.0, 0.0)
    assert share == pytest.approx([0.5] * 4)
    assert P.constrained_fit(np.eye(4), np.arange(4.0), 2.0, 0.1).sum() == pytest.approx(2.0)


@pytest.mark.parametrize("method", DESIGN_MODES + BASELINES)
def test_every_method_on_an_additive_game(spark, method):
    coef = [0.5, -1.0, 2.0, 3.5, 0.25, 1.0]
    got = shares(attribute(players(spark, coef=coef), U.additive("coef"), method, 30, "m", pool=4, tolerance=0.0))
    # Marginals of an additive game are constants, and so is the regression; the other methods only sample.
    exact = method in ("kernel_shap", "permutation", "truncated", "antithetic", "latin_square", "component_array", "orthogonal")
    assert got == pytest.approx(coef, abs=1e-9 if exact else 1.6)


def test_unknown_method_and_missing_strata(spark):
    p = players(spark, cost=[1, 2, 3, 4, 5, 6, 7, 8])
    with pytest.raises(ValueError):
        attribute(p, U.max_cost(), "nothing")
    with pytest.raises(Exception, match="unseen strata"):
        attribute(p, U.max_cost(), "iid", 1, missing="raise").collect()
    with pytest.raises(Exception, match="at least 4"):
        attribute(players(spark, cost=[1, 2, 3]), U.max_cost(), "iid", 2).collect()


@pytest.mark.parametrize("q", [2, 3, 4, 5, 7, 8, 9, 16, 25, 27])
def test_field_axioms(q):
    s, m = (np.array(t) for t in field_tables(q))
    assert all(sorted(row) == list(range(q)) for row in s.tolist())
    assert all(sorted(row) == list(range(q)) for row in m[1:].tolist())
    a, b, c = np.random.default_rng(q).integers(0, q, (3, 200))
    assert (m[a, s[b, c]] == s[m[a, b], m[a, c]]).all() and (m[a, m[b, c]] == m[m[a, b], c]).all()
    if q == 9:
        assert m[3][3] == 7 and s[3][6] == 0


def test_latin_squares(spark):
    rows = D.latin_square(games(spark, 1, 2, 3, 6, 10), 1, "ls").collect()
    seen = Counter((r["game_id"], r["pos"], r["player"]) for r in rows)
    assert set(seen.values()) == {1}
    assert len(seen) == sum(n * n for n in (1, 2, 3, 6, 10))


def test_component_arrays_cover_ordered_pairs(spark):
    for n in (4, 5, 8, 9):
        rows = D.component_array(games(spark, n), 1, "c").collect()
        orders = {}
        for r in rows:
            orders.setdefault(r["sample"], {})[r["pos"]] = r["player"]
        assert len(orders) == n * (n - 1)
        for a, b in ((1, 2), (1, n), (2, 3)):
            assert len({(o[a], o[b]) for o in orders.values()}) == n * (n - 1)


def test_orthogonal_rows():
    for n in (2, 5, 51):
        rows = G.orthonormal_rows(n - 1, n, np.random.default_rng(n))
        assert rows @ rows.T == pytest.approx(np.eye(n - 1), abs=1e-10)
        assert rows.sum(axis=1) == pytest.approx(0, abs=1e-10)


def test_orbits_are_balanced(spark):
    g = games(spark, 7)
    design = G.expand_orbits(G.orbit_base_design(g, F.lit(8), "o"), "o").collect()
    per_size = Counter(r["size"] for r in design)
    holding = Counter((r["size"], m) for r in design for m in r["members"])
    assert all(holding[(s, p)] * 7 == s * per_size[s] for s in per_size for p in range(7))
    assert set(per_size) == {2, 3, 4, 5}


def test_greedy_designs_are_more_even_than_random():
    rng = np.random.default_rng(0)
    n, s, rows = 12, 4, 60

    def spread(picks):
        count = np.zeros(n)
        for row in picks:
            count[row] += 1
        return count.std()

    greedy = spread(G.greedy_rows(n, [s] * rows, rng, 16, 1 / 16, 1.0, "size"))
    random = np.mean([spread([rng.choice(n, s, replace=False) for _ in range(rows)]) for _ in range(20)])
    assert greedy < random / 2


def test_no_coalition_repeats_before_its_slice_is_used_up():
    rows = G.greedy_rows(6, [2] * 15, np.random.default_rng(1), 4, 0.1, 1.0, "size")
    assert len({tuple(r) for r in rows}) == 15


def test_systematic_counts(spark):
    rows = D.systematic_schedule(games(spark, 9), 41, "s", INNER).collect()
    weights = {s: 1 / np.sqrt(s * (9 - s)) for s in range(2, 8)}
    total = sum(weights.values())
    counts = Counter(r["size"] for r in rows)
    assert all(abs(counts[s] - 41 * w / total) < 1 for s, w in weights.items())
    assert sorted(r["sample"] for r in rows) == list(range(41))


@pytest.mark.parametrize("n,samples", [(5, 2), (6, 7), (9, 11), (9, 40)])
def test_minimum_one_counts(spark, n, samples):
    got = {r["size"]: (r["count"], r["target"]) for r in B.minimum_one_counts(games(spark, n), F.lit(samples), INNER).collect()}
    assert sum(c for c, _ in got.values()) == samples and min(c for c, _ in got.values()) >= 1
    best = sum((c - t) ** 2 for c, t in got.values())
    for a in got:
        for b in got:
            if a != b and got[a][0] > 1:
                moved = sum((c - (s == a) + (s == b) - t) ** 2 for s, (c, t) in got.items())
                assert moved >= best - 1e-9


def test_pair_fill_covers_every_ordered_pair(spark):
    parts = D.partition_blocks(games(spark, 7), "p").where("complement = 0").select("game_id", "n", F.col("base_size").alias("size"), "members")
    rows = parts.select("size", "members").collect() + G.fill_pairs(parts, "p").select("size", "members").collect()
    for s in (1, 2, 3):
        seen = {(i, j) for r in rows if r["size"] == s for i in r["members"] for j in range(7) if j not in r["members"]}
        assert len(seen) == 42


def test_saved_runs_of_another_configuration_stop(spark):
    from allotment.sources.results import config_hash, pending_cells
    plan = games(spark, 3, 4).select("game_id")
    done = plan.where("game_id = 0").withColumn("config", config_hash("a"))
    assert [r[0] for r in pending_cells(plan, done, ["game_id"], config_hash("a")).collect()] == [1]
    with pytest.raises(Exception, match="another configuration"):
        pending_cells(plan, done, ["game_id"], config_hash("b")).collect()


def test_bad_utilities_stop(spark):
    from allotment.operators.custom import apply_batches, require_finite
    bad = apply_batches(games(spark, 3), lambda pdf: pdf["n"] * float("nan"), ["game_id"])
    with pytest.raises(Exception, match="not finite"):
        require_finite(bad).collect()


def test_stream_refuses_another_configuration(spark, tmp_path):
    from allotment.streaming.moments import check_configuration
    check_configuration(spark, str(tmp_path), "a")
    check_configuration(spark, str(tmp_path), "a")
    with pytest.raises(ValueError):
        check_configuration(spark, str(tmp_path), "b")


@pytest.mark.parametrize("multiply", [P._both, P._one_of])
def test_pair_sums_in_parts_and_tiles(monkeypatch, multiply):
    rng = np.random.default_rng(1)
    rows = [(g, n, 0, t, p, float(g + t), 1.0) for g, n in ((3, 4), (1, 9), (2, 4)) for t in range(11) for p in rng.permutation(n)[:1 + t % (n - 1)]]
    columns = [np.array(c) for c in zip(*rows)]

    def sums(cells):
        monkeypatch.setattr(P, "CELLS", cells)
        out = {}
        for g, s, i, j, parts in P.pair_sums(*columns, multiply):
            assert len(g) <= max(cells, 9)
            for *key, a, b in zip(g, s, i, j, *parts[:2]):
                out[tuple(key)] = out.get(tuple(key), 0) + np.array([a, b])
        return {k: tuple(v) for k, v in out.items()}

    assert sums(4) == sums(30) == sums(2**20)


@pytest.mark.parametrize("by_size", [False, True])
def test_pair_sums_match_loops(spark, by_size):
    """Games of several sizes in several packs, a coalition without a value, a game never sampled."""
    rng = np.random.default_rng(3)
    rows, coalitions = [], []
    for game, n, draws in ((1, 2, 3), (2, 5, 40), (3, 5, 1), (4, 9, 17), (5, 1, 0), (6, 4, 0)):
        for sample in range(draws):
            z = np.zeros(n, bool)
            z[rng.permutation(n)[:rng.integers(1, n)]] = True
            value = None if (game, sample) == (4, 3) else float(rng.integers(100))
            rows += [(game, sample // 7, sample, int(z.sum()), p, bool(z[p]), value, n) for p in range(n)]
            if value is not None:
                coalitions.append((game, int(z.sum()) if by_size else 0, z, value))
    sampled = spark.createDataFrame(rows, "game_id long, block long, sample long, size int, player int, inside boolean, value double, n int")
    one_of, both = Counter(), Counter()
    for game, size, z, value in coalitions:
        for i in np.flatnonzero(z):
            for j in range(len(z)):
                into = both if z[j] else one_of
                into[game, size, i, j, "count"] += 1
                into[game, size, i, j, "total"] += value
    size = lambda r: r["size"] if by_size else 0
    for r in (got := P.contrasts(sampled, by_size).collect()):
        for i, j, count, total in ((r["i"], r["j"], r["seen"], r["total"]), (r["j"], r["i"], r["back"], r["back_total"])):
            assert (one_of[r["game_id"], size(r), i, j, "count"], one_of[r["game_id"], size(r), i, j, "total"]) == (count, total)
    assert sum(r["seen"] > 0 for r in got) == len(one_of) // 2
    got = P.co_membership(sampled, by_size, "value").collect()
    assert len(got) == len(both) // 2
    for r in got:
        key = r["game_id"], size(r), r["i"], r["j"]
        assert r["count"] == both[*key, "count"] and r["total"] == r["weighted"] == both[*key, "total"]
    ends = spark.createDataFrame([(g, p, n, 0.0, 6.0) for g, n in ((1, 2), (5, 1), (6, 4)) for p in range(n)],
                                 "game_id long, player int, n int, empty_value double, full_value double")
    shares_ = {(r["game_id"], r["player"]): r["share"] for r in P.differential(sampled, ends, by_size).collect()}
    assert shares_[5, 0] == 6.0 and shares_[6, 0] is None and len(shares_) == 7
    cover = {(r["game_id"], r["size"] if by_size else 0): r for r in P.pair_coverage(sampled, ends, by_size).collect()}
    assert len(cover) == (1 + 3 if by_size else 2)
    assert (cover[6, 1 if by_size else 0]["pairs"], cover[6, 1 if by_size else 0]["covered"], cover[6, 1 if by_size else 0]["least"]) == (12, 0, 0)


def test_pool_ends_and_uses_every_subset_once():
    """A slice too large to be listed at first is drawn to its end, each subset once, and starts over."""
    import numpy as np

    from allotment.operators.balanced import ENUMERATE_UP_TO, CandidatePool
    pool = CandidatePool(15, 5, np.random.default_rng(0))
    assert pool.total == 3003 > ENUMERATE_UP_TO
    seen = set()
    for _ in range(pool.total):
        rows = pool.draw(64)
        assert 1 <= len(rows) <= 64 and (rows.sum(axis=1) == 5).all()
        seen.add(rows[0].tobytes())
        pool.take(0)
    assert len(seen) == pool.total and len(pool.draw(64)) == 64


def test_slices_are_balanced_as_a_whole(spark):
    """More rows than 4,096: no coalition of a size comes twice before all have come, and players stay more even than by chance."""
    rows = G.per_size_design(games(spark, 16), F.lit(9000), "whole").collect()
    assert len(rows) == 9000
    for s in {r["size"] for r in rows}:
        sets = [tuple(r["members"]) for r in rows if r["size"] == s]
        total = math.comb(16, s)
        assert max(Counter(sets).values()) == -(-len(sets) // total)
        held = Counter(m for members in sets for m in members)
        assert np.std(list(held.values())) < np.sqrt(len(sets) * s / 16 * (1 - s / 16)) / 4


def test_large_stratified_slices_end(spark):
    assert G.stratified_design(games(spark, 15), F.lit(12000), "end").count() == 12000


def test_too_few_samples_for_all_sizes_stop(spark):
    with pytest.raises(Exception, match="fewer samples than sizes"):
        B.minimum_one_counts(games(spark, 30), F.lit(8), INNER).collect()
    with pytest.raises(Exception, match="fewer samples than sizes"):
        attribute(players(spark, cost=list(range(1, 13))), U.max_cost(), "complete_orbits", 4).collect()


def test_boundary_values_of_real_weights(spark):
    from allotment.operators.interactions import boundary_values
    terms = spark.createDataFrame([(1, 0, 0, 0.5, 1), (1, 1, 0, 0.25, 2), (1, 1, 1, 0.25, 2)],
                                  "game_id BIGINT, term_id INT, player INT, weight DOUBLE, degree INT")
    got = boundary_values(players(spark, cost=[1, 1]), terms).orderBy("player").collect()
    assert [(r["full_value"], r["single_value"], r["without_value"]) for r in got] == [(0.75, 0.5, 0.0), (0.75, 0.0, 0.5)]


def test_stratified_differential_covers_all_pairs_within_its_calls(spark):
    from allotment.operators import covered_pairs as C
    p = U.boundary(Split(players(spark, cost=[3, 1, 7, 4, 4, 9])), U.max_cost()).rows()
    covering = C.covering_rows(games(spark, 6, 9), "c").collect()
    assert len({(r["game_id"], r["sample"]) for r in covering}) == len(covering)
    for game, n in enumerate((6, 9)):
        for s in range(1, n):
            rows = [r["members"] for r in covering if r["game_id"] == game and r["size"] == s]
            assert len({(i, j) for m in rows for i in m for j in range(n) if j not in m}) == n * (n - 1)
    got, runs = C.estimate(p, U.max_cost(), F.lit(4000), "c")
    run = runs.collect()[0]
    assert (run["status"], run["calls"]) == ("ok", 4000) and run["covering_calls"] + run["random_calls"] == 3998
    assert shares(got) == pytest.approx(shares(X.airport_shares(players(spark, cost=[3, 1, 7, 4, 4, 9]))), abs=0.25)
    assert sum(shares(got)) == pytest.approx(9)
    short, runs = C.estimate(p, U.max_cost(), F.lit(44), "c")  # 4 n ln n = 43.0...: one call short
    assert runs.collect()[0]["status"] == "budget_infeasible" and runs.collect()[0]["calls"] == 0
    assert shares(short) == [None] * 6


@pytest.mark.parametrize("one_pass", [False, True])
def test_logistic_models_train_on_rows(spark, one_pass):
    """Weights against plain loops over the rows; twelve labels, rows that their class means do not stand for, one class alone."""
    from allotment.operators import learning as L
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(3)), int(y), [float(v) for v in rng.normal(size=2) * (1 + y)]) for i, y in enumerate(rng.integers(0, 12, 150))]
    rows += [(200, 3, 7, [1.0, 2.0])]
    train = spark.createDataFrame(rows, "point_id long, player int, label int, features array<double>")
    members = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (2, 3), (3, 0), (3, 1), (3, 2), (4, 9)], "sample long, player int")
    labels = L.classes(train, train)
    assert labels == list(range(12))
    models = L.logistic_models(members, train, labels, "fit", one_pass=one_pass, steps=5)
    got = {r["sample"]: np.array(r["weights"]).T for r in models.collect()}
    assert set(got) == {0, 1, 2, 3} and got[2][-1].argmax() == 7
    keys = dict(train.select("point_id", L.order_key("fit", F.col("point_id"))).collect())
    for sample, held in {0: [0, 2], 1: [1], 3: [0, 1, 2]}.items():
        mine = sorted((r for r in rows if r[1] in held), key=lambda r: (keys[r[0]], r[0]))
        w = np.zeros((3, 12))
        if one_pass:
            for p in (held[i] for i in G.generator("fit", *held).permutation(len(held))):
                for _, player, y, x in mine:
                    if player == p:
                        x = np.array([*x, 1.0])
                        w += 0.5 * np.outer(x, np.eye(12)[y] - L.softmax(x @ w))
        else:
            x, y = np.array([[*r[3], 1.0] for r in mine]), [r[2] for r in mine]
            for _ in range(5):
                w += 0.5 * x.T @ (np.eye(12)[y] - L.softmax(x @ w)) / len(mine)
        assert got[sample] == pytest.approx(w)
    scores = L.logistic_scores(train.select("label", "features"), models, labels, 5).collect()
    assert len(scores) == 4 and all(0 <= r["accuracy"] <= 1 and r["log_likelihood"] < 0 for r in scores)


def test_critical_values(spark):
    """Published quantiles, the closed forms of one and two degrees of freedom, and the tail at the answer."""
    from allotment.functions.student import critical, simultaneous_t, upper_tail
    for df, tail, want in ((10, 0.025, 2.2281), (30, 0.025, 2.0423), (5, 0.005, 4.0321), (11, 0.01, 2.7181), (1_000_000, 0.025, 1.9600)):
        assert critical(df, tail) == pytest.approx(want, abs=5e-5)
    for tail in (0.4, 0.025, 1e-3, 1e-7):
        assert critical(1, tail) == pytest.approx(1 / math.tan(math.pi * tail), rel=1e-9)
        assert critical(2, tail) == pytest.approx((1 - 2 * tail) / math.sqrt(2 * tail * (1 - tail)), rel=1e-9)
        for df in (3, 17, 400, 50_000):
            assert upper_tail(critical(df, tail), df) == pytest.approx(tail, rel=1e-9)
    rows = spark.createDataFrame([(12, 1), (12, 5), (1, 3), (0, 2), (None, 2), (12, 5)], "count long, players long")
    got = [r[0] for r in rows.coalesce(1).select(simultaneous_t(F.col("count"), F.col("players"), 0.05)).collect()]
    assert got == [pytest.approx(critical(11, 0.025)), pytest.approx(critical(11, 0.005)), None, None, None, pytest.approx(critical(11, 0.005))]


def test_pair_batches_are_taken_in_pieces(monkeypatch):
    """A batch of many packs is cut between packs; none is lost, and a pack above the limit stays whole."""
    import pyarrow as pa

    from allotment.operators import pairs as P
    monkeypatch.setattr(P, "MEMBERS", 4)
    batch = pa.record_batch({"game_id": list(range(6)), "rows": [[1, 2], [3], [], [4, 5, 6, 7, 8], [9, 10, 11], [12]]})
    parts = list(P.pieces(batch))
    assert [p.column("game_id").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5]]
    assert [p.column("rows").flatten().to_pylist() for p in parts] == [[1, 2, 3], [4, 5, 6, 7, 8], [9, 10, 11, 12]]
    assert list(P.pieces(batch.slice(0, 0))) == []
