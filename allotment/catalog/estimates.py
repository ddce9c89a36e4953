"""Utilities, estimators and exact answers that are not in `sampling`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from allotment.attribute import attribute
from allotment.catalog import sql as q
from allotment.catalog.designs import ANY_FIELD_SQL, coa_rows_sql, LATIN_SQL, listed
from allotment.catalog.plans import GAMES_SQL, MARGINAL_COUNTS_SQL, games
from allotment.catalog.registry import query
from allotment.catalog.sampling import INNER_SQL, SHARES, STRATA_SQL, T, harmonic_cte, inner_cost, max_game, shares, vote_game
from allotment.functions.hashing import tidy
from allotment.functions.laws import INNER, KERNEL
from allotment.operators import balanced as G
from allotment.operators import covered_pairs as C
from allotment.operators import designs as D
from allotment.operators import estimators as E
from allotment.operators import exact as X
from allotment.operators import interactions as I
from allotment.operators import pairs as P
from allotment.operators import utilities as U
from allotment.operators.custom import apply_batches, require_finite
from allotment.operators.skew import Split, in_a_row, large
from allotment.plans import budget as B
from allotment.sources import tables as S

VALUES = "SELECT DISTINCT game_id, sample, CAST(size AS INTEGER) AS size, value FROM ev"


def values(split):
    return split.rows().where("pos = 1").select("game_id", "sample", "size", "value")


# --- utilities ---------------------------------------------------------------------------------

@query("max_cost_values", q.with_(q.game("max", 4), q.ordered(T, "iid"), q.sizes(T, "iid", "inner"), q.evaluated()) + VALUES)
def max_cost_values(spark, folder):
    return values(U.evaluate(D.iid_design(S.at_least(S.customer_orders(spark, folder), 4), T, "iid", INNER), U.max_cost()))


@query("majority_values", q.with_(q.game("vote", 4), q.ordered(T, "iid"), q.sizes(T, "iid", "inner"), q.evaluated(q.VOTE_VALUE)) + VALUES)
def majority_values(spark, folder):
    return values(U.evaluate(D.iid_design(S.at_least(S.customer_orders(spark, folder), 4), T, "iid", INNER), U.weighted_majority()))


@query("additive_values", q.with_(q.game("max", 4), q.ordered(T, "iid"), q.sizes(T, "iid", "inner"),
       q.evaluated(("CAST(3 + sum(cost) FILTER (WHERE pos <= size) OVER g AS DOUBLE)", "0"))) + VALUES)
def additive_values(spark, folder):
    players = S.at_least(S.customer_orders(spark, folder), 4)
    return values(U.evaluate(D.iid_design(players, T, "iid", INNER), U.additive("cost", 3.0)))


CHANNEL_SQL = """dy AS (SELECT user_id AS game_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS term_id, event_type AS channel,
  CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS part FROM events GROUP BY 1, 2, 3),
ch AS (SELECT game_id, channel, sum(part) AS coef, row_number() OVER (PARTITION BY game_id ORDER BY channel) - 1 AS player, count(*) OVER (PARTITION BY game_id) AS n FROM dy GROUP BY 1, 2),
tm AS (SELECT dy.game_id, dy.term_id, ch.player, sum(part) OVER w AS weight, count(*) OVER w AS degree FROM dy JOIN ch USING (game_id, channel) WINDOW w AS (PARTITION BY dy.game_id, dy.term_id))"""


@query("interaction_values", q.with_(CHANNEL_SQL, q.ordered(8, "chan", "ch"), q.sizes(8, "chan", "uniform", "ch")) + """
, mb AS (SELECT game_id, sample, player FROM rk JOIN sz USING (game_id, sample) WHERE pos <= size),
mt AS (SELECT game_id, sample, term_id FROM mb JOIN tm USING (game_id, player) GROUP BY 1, 2, 3 HAVING count(*) = max(degree)),
pd AS (SELECT game_id, sample, sum(w) AS value FROM mt JOIN (SELECT DISTINCT game_id, term_id, weight AS w FROM tm) t USING (game_id, term_id) GROUP BY 1, 2)
SELECT s.game_id, s.sample, CAST(coalesce(value, 0) AS BIGINT) AS value FROM (SELECT DISTINCT game_id, sample FROM mb) s LEFT JOIN pd USING (game_id, sample)""")
def interaction_values(spark, folder):
    players, terms = S.channel_game(spark, folder)
    rows = D.complement_design(Split(players), 8, "chan").rows().where("inside")
    return I.coalition_values(rows, terms, ["game_id", "sample"])


PRIORITY_SQL = """pr0 AS (SELECT o_custkey AS game_id, o_orderpriority AS priority, count(*) AS weight,
  sum(CAST(floor(o_totalprice/1000) AS BIGINT)) AS cost FROM orders GROUP BY 1, 2),
pr AS (SELECT *, CAST(row_number() OVER (PARTITION BY game_id ORDER BY priority) - 1 AS INTEGER) AS player, count(*) OVER (PARTITION BY game_id) AS n,
  sum(weight) OVER (PARTITION BY game_id)//2 + 1 AS quota FROM pr0)"""
TABLE_SQL = """mk AS (SELECT game_id, n, m AS mask, quota FROM pr, unnest(range(0, CAST(1 << CAST(n AS INTEGER) AS BIGINT))) r(m) WHERE player = 0),
tb AS (SELECT mk.game_id, mk.n, mask, CAST(coalesce(max(cost) FILTER (WHERE mask & (1 << player) > 0), 0) AS DOUBLE) AS top,
  CAST(CASE WHEN coalesce(sum(weight) FILTER (WHERE mask & (1 << player) > 0), 0) >= first(mk.quota) THEN 1 ELSE 0 END AS DOUBLE) AS win,
  bit_count(mask) AS s FROM mk JOIN pr USING (game_id) GROUP BY 1, 2, 3)"""


def subset_table(spark, folder, utility):
    """Stored values of all subsets of every customer's priorities (at most 2^5 rows per game)."""
    players = S.customer_priorities(spark, folder).rows()
    masks = X.all_coalitions(players.where("player = 0"))
    members = masks.join(large(players.drop("n")), "game_id").withColumn("inside", F.expr("(shiftright(mask, player) & 1) = 1"))
    state = members.groupBy("game_id", "n", "mask").agg(utility.state(F.col("inside")).alias("_s"), F.first("quota").alias("quota"))
    return state.select("game_id", "n", "mask", utility.value(F.col("_s")).alias("utility"))


@query("table_lookup_values", q.with_(PRIORITY_SQL, TABLE_SQL, q.ordered(8, "look", "pr"), q.sizes(8, "look", "uniform", "pr")) + """
, mm AS (SELECT game_id, sample, CAST(sum(1 << player) AS BIGINT) AS mask FROM rk JOIN sz USING (game_id, sample) WHERE pos <= size GROUP BY 1, 2)
SELECT game_id, sample, CAST(mask AS BIGINT) AS mask, top AS utility FROM mm JOIN tb USING (game_id, mask)""")
def table_lookup_values(spark, folder):
    rows = D.complement_design(S.customer_priorities(spark, folder), 8, "look").rows().where("inside")
    masks = U.evaluate_grouped(rows, U.member_mask(), ["game_id", "sample"]).withColumnRenamed("value", "mask")
    return masks.join(large(subset_table(spark, folder, U.max_cost())), ["game_id", "mask"]).select("game_id", "sample", "mask", "utility")


def price_spread(batch):
    """A user's own utility over a batch of coalitions: dearest minus cheapest member."""
    return batch["costs"].map(lambda c: float(np.max(c) - np.min(c)))


@query("custom_batch_values", q.with_(q.game("max", 4), q.ordered(T, "iid"), q.sizes(T, "iid", "inner"),
       q.evaluated(("CAST(max(cost) FILTER (WHERE pos <= size) OVER g - min(cost) FILTER (WHERE pos <= size) OVER g AS DOUBLE)", "0"))) + VALUES)
def custom_batch_values(spark, folder):
    rows = D.iid_design(S.at_least(S.customer_orders(spark, folder), 4), T, "iid", INNER).rows().where("inside")
    coalitions = rows.groupBy("game_id", "sample", "size").agg(F.collect_list("cost").alias("costs"))
    return require_finite(apply_batches(coalitions, price_spread, ["game_id", "sample", "size"]))


@query("boundary_values", q.with_(q.game("max")) + "SELECT game_id, player, empty_value, full_value, single_value, without_value FROM pl")
def boundary_values(spark, folder):
    """Boundary coalitions evaluated as rows (kind, player, utility), then decoded per player."""
    players = max_game(spark, folder).rows()
    kinds = F.array(F.struct(F.lit("single").alias("kind"), F.col("single_value").alias("u")),
                    F.struct(F.lit("loo").alias("kind"), F.col("without_value").alias("u")))
    ends = F.array(F.struct(F.lit("empty").alias("kind"), F.col("empty_value").alias("u")),
                   F.struct(F.lit("full").alias("kind"), F.col("full_value").alias("u")))
    stored = players.select("game_id", "n", F.when(F.col("player") >= 0, F.col("player")).alias("player"),
                            F.inline(F.when(F.col("player") == 0, F.concat(ends, kinds)).otherwise(kinds)))
    return U.decode_boundary(stored.withColumnRenamed("u", "utility"))


@query("path_marginals", q.with_(q.game("max"), q.ordered(3, "marg"), q.path_values()) + "SELECT game_id, sample, CAST(pos AS INTEGER) AS pos, player, marginal FROM pm")
def path_marginals(spark, folder):
    paths = U.path_values(D.random_order(max_game(spark, folder), 3, "marg"), U.max_cost())
    return paths.rows().select("game_id", "sample", "pos", "player", "marginal")


# --- estimators --------------------------------------------------------------------------------

@query("boundary_share", q.with_(q.game("max", 2), q.BOUNDARY_SHARE) + f"SELECT game_id, player, {q.tidy('boundary_share')} AS share FROM bs")
def boundary_share(spark, folder):
    split = E.boundary_part(max_game(spark, folder, 2))
    return shares(split.rows().withColumn("share", F.col("boundary_share")))


STRAT_T = 96


@query("stratified_linear", INNER_SQL("strat", STRAT_T) + """,
rv AS (SELECT *, value - (empty_value + size*(full_value - empty_value)/n) AS r FROM ev),
st AS (SELECT game_id, player, size, first(n) AS n, first(boundary_share) AS b, (sum(CASE WHEN inside THEN r ELSE 0 END) - sum(r)*size/first(n))/count(*) AS m FROM rv GROUP BY 1, 2, 3)"""
       + f"SELECT game_id, player, {q.tidy('CASE WHEN count(*) = first(n) - 3 THEN first(b) + sum(m*n/CAST(size*(n-size) AS DOUBLE)) END')} AS share FROM st GROUP BY 1, 2")
def stratified_linear(spark, folder):
    return shares(E.stratified_linear(inner_cost(spark, folder, "strat", STRAT_T)))


@query("ratio_covered_only", INNER_SQL("cover", STRAT_T) + "," + STRATA_SQL + f"""
SELECT game_id, player, {q.tidy('CASE WHEN count(*) FILTER (WHERE k > 0 AND k < rws) = first(n) - 3 THEN first(b) + sum(ins/nullif(k,0) - (tot - coalesce(ins,0))/nullif(rws-k,0))/first(n) END')} AS share
FROM st GROUP BY 1, 2""")
def ratio_covered_only(spark, folder):
    return shares(E.ratio(inner_cost(spark, folder, "cover", STRAT_T), "raise"))


@query("ratio_balanced", q.with_(q.game("max", 4), q.BOUNDARY_SHARE) + """,
sh0 AS (SELECT a.game_id, a.n, s AS size, h AS sample, a.player, ((a.player - h) % a.n + a.n) % a.n < s AS inside, a.cost, a.boundary_share
  FROM bs a, unnest(range(2, a.n - 1)) rs(s), unnest(range(0, a.n)) rh(h)),
ev AS (SELECT *, CAST(max(cost) FILTER (WHERE inside) OVER (PARTITION BY game_id, size, sample) AS DOUBLE) AS value FROM sh0),
""" + STRATA_SQL + f"""SELECT game_id, player, {q.tidy('first(b) + sum(ins/k - (tot - ins)/(rws - k))/first(n)')} AS share FROM st GROUP BY 1, 2""")
def ratio_balanced(spark, folder):
    """Strict balance on complete cyclic orbits of the first s players at every inner size."""
    players = E.boundary_part(max_game(spark, folder, 4)).rows()
    games_ = players.where("player = 0").select("game_id", "n")
    bases = games_.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n") - 2))).withColumn(
        "members", F.sequence(F.lit(0), F.col("size") - 1))
    orbit = D.cyclic_orbit(bases).withColumn("design", F.lit("orbit")).withColumn(
        "sample", (F.col("size") * 1000000 + F.col("shift")).cast("bigint"))
    sampled = U.evaluate(Split(G.sampled_rows(orbit, players)), U.max_cost())
    return shares(E.ratio(sampled, "balanced"))


@query("size_profile_linear", INNER_SQL("lin") + """,
pf AS (SELECT *, avg(value) OVER (PARTITION BY game_id, size) AS b FROM ev),
wt AS (SELECT *, (value - b)*sqrt(n/CAST(size*(n-size) AS DOUBLE)) AS w FROM pf),
zz AS (SELECT DISTINCT n, z FROM law)""" + f"""
SELECT game_id, player, {q.tidy('first(boundary_share) + first(z)*sqrt(first(wt.n))*(sum(CASE WHEN inside THEN w ELSE 0 END) - sum(w*size/wt.n))/count(*)')} AS share
FROM wt JOIN zz USING (n) GROUP BY 1, 2""")
def size_profile_linear(spark, folder):
    """The profile is the mean value of the sampled coalitions of a game at each size."""
    sampled = inner_cost(spark, folder, "lin")
    return shares(E.linear(E.with_size_profile(sampled), "profile"))


def pair_sql(by_size=False, seed="diff", samples=48):
    return q.with_(q.game("max", 2), q.ordered(samples, seed), q.sizes(samples, seed, "kernel"), q.evaluated()) + pair_sums_sql(by_size)


def pair_sums_sql(by_size):
    lv = "game_id, size" if by_size else "game_id"
    return f""",
mb AS (SELECT game_id, sample, size, player, value FROM ev WHERE inside),
ow AS (SELECT {lv}, player AS i, count(*) AS c, sum(value) AS v FROM mb GROUP BY ALL),
bo AS (SELECT {', '.join('a.' + x for x in lv.split(', '))}, a.player AS i, b.player AS j, count(*) AS c, sum(a.value) AS v FROM mb a JOIN mb b ON a.game_id = b.game_id AND a.sample = b.sample AND a.player <> b.player GROUP BY ALL),
gr AS (SELECT p.game_id, p.n, p.player AS i, r.j AS j{', z.s AS size' if by_size else ''} FROM pl p, unnest(range(0, p.n)) r(j){', unnest(range(1, p.n)) z(s)' if by_size else ''} WHERE p.player <> r.j),
pm AS (SELECT gr.*, coalesce(ow.c, 0) - coalesce(bo.c, 0) AS seen,
  (coalesce(ow.v, 0) - coalesce(bo.v, 0))/nullif(coalesce(ow.c, 0) - coalesce(bo.c, 0), 0) AS m
  FROM gr LEFT JOIN ow USING ({lv}, i) LEFT JOIN bo USING ({lv}, i, j)),
gp AS (SELECT game_id, count(*) FILTER (WHERE m IS NULL) AS gaps FROM pm GROUP BY 1),
sw AS (SELECT game_id, p AS player, sum(x) AS swing FROM (SELECT game_id, i AS p, m AS x FROM pm UNION ALL SELECT game_id, j, -m FROM pm) u GROUP BY 1, 2)"""


def _pair_share(scale):
    expr = q.tidy(f"CASE WHEN gaps = 0 THEN (full_value - empty_value)/n + swing/({scale}) END")
    return f"SELECT game_id, player, {expr} AS share FROM pl JOIN gp USING (game_id) JOIN sw USING (game_id, player)"


def kernel_sample(spark, folder, seed, samples):
    players = max_game(spark, folder, 2)
    return players, U.evaluate(D.iid_design(players, samples, seed, KERNEL), U.max_cost())


@query("differential", pair_sql() + _pair_share("n"))
def differential(spark, folder):
    players, sampled = kernel_sample(spark, folder, "diff", 48)
    return shares(P.differential(sampled.rows(), players.rows()))


@query("stratified_differential")
def stratified_differential(spark, folder):
    """Every ordered pair is covered at every size first (partitions, fills, complements); what is left of the calls is random."""
    estimate, _ = C.estimate(max_game(spark, folder, 2).rows(), U.max_cost(), F.expr(SDIFF_CALLS), "diff")
    return shares(estimate)


@query("stratified_differential_covered", q.with_(q.game("max", 2)) + """,
sh0 AS (SELECT a.game_id, a.n, s AS size, s*1000000 + h AS sample, a.player, ((a.player - h) % a.n + a.n) % a.n < s AS inside, a.cost
  FROM pl a, unnest(range(1, a.n)) rs(s), unnest(range(0, a.n)) rh(h)),
ev AS (SELECT *, CAST(max(cost) FILTER (WHERE inside) OVER (PARTITION BY game_id, sample) AS DOUBLE) AS value FROM sh0)""" + pair_sums_sql(True) + _pair_share("n*(n-1)"))
def stratified_differential_covered(spark, folder):
    """Complete cyclic orbits of the first s players at every size tell every ordered pair apart: no share is null."""
    players = max_game(spark, folder, 2).rows()
    games_ = players.where("player = 0").select("game_id", "n")
    bases = games_.withColumn("size", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).withColumn(
        "members", F.sequence(F.lit(0), F.col("size") - 1))
    orbit = D.cyclic_orbit(bases).withColumn("design", F.lit("orbit")).withColumn(
        "sample", (F.col("size") * 1000000 + F.col("shift")).cast("bigint"))
    rows = G.sampled_rows(orbit, players).withColumn("block", F.when(F.col("n") <= 128, F.lit(D.WHOLE)).otherwise(F.col("size")).cast("bigint"))
    return shares(P.differential(U.evaluate(Split(rows), U.max_cost()).rows(), players, by_size=True))


SDIFF_CALLS = "ceil(6*n*ln(n) + 4*n*ln(n)*ln(n)) + 2"


@query("sdiff_shares")
def sdiff_shares(spark, folder):
    """Covering rows, then random ones, at 6 n ln n + 4 n (ln n)^2 calls; single orders are out of the method's domain."""
    estimate, _ = C.estimate(max_game(spark, folder, 1).rows(), U.max_cost(), F.expr(SDIFF_CALLS), "sdiff")
    return estimate.select("game_id", "player", tidy(F.col("share")).alias("share"), "status")


@query("sdiff_efficiency", q.with_(q.game("max")) + f"""SELECT game_id, CAST(CASE WHEN n >= 2 THEN {SDIFF_CALLS} ELSE 0 END AS BIGINT) AS calls,
  CASE WHEN n >= 2 THEN {q.tidy('full_value - empty_value', 2)} END AS total FROM pl WHERE player = 0""")
def sdiff_efficiency(spark, folder):
    """The shares of every game sum to v(all) - v(empty), and its calls are exactly the cap."""
    estimate, runs = C.estimate(max_game(spark, folder, 1).rows(), U.max_cost(), F.expr(SDIFF_CALLS), "sdiff")
    totals = estimate.groupBy("game_id").agg(tidy(F.sum("share"), 2).alias("total"))
    return runs.join(large(totals), "game_id").select("game_id", "calls", "total")


@query("pair_coverage", pair_sql() + """SELECT game_id, count(*) AS pairs, CAST(count(*) FILTER (WHERE seen > 0) AS BIGINT) AS covered,
  CAST(min(seen) AS BIGINT) AS least, CAST(max(seen) AS BIGINT) AS most FROM pm GROUP BY 1""")
def pair_coverage(spark, folder):
    players, sampled = kernel_sample(spark, folder, "diff", 48)
    return P.pair_coverage(sampled.rows(), players.rows())


@query("pair_coverage_by_size", pair_sql(True) + """SELECT game_id, CAST(size AS INTEGER) AS size, count(*) AS pairs, CAST(count(*) FILTER (WHERE seen > 0) AS BIGINT) AS covered,
  CAST(min(seen) AS BIGINT) AS least, CAST(max(seen) AS BIGINT) AS most FROM pm GROUP BY 1, 2""")
def pair_coverage_by_size(spark, folder):
    players, sampled = kernel_sample(spark, folder, "diff", 48)
    return P.pair_coverage(sampled.rows(), players.rows(), by_size=True)


@query("kernel_moments", pair_sql() + """SELECT game_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, c AS count, CAST(v AS DOUBLE) AS total FROM bo
UNION ALL SELECT game_id, i, i, c, CAST(v AS DOUBLE) FROM ow""")
def kernel_moments(spark, folder):
    _, sampled = kernel_sample(spark, folder, "diff", 48)
    return P.kernel_moments(sampled.rows())


@query("kernel_shap")
def kernel_shap(spark, folder):
    players, sampled = kernel_sample(spark, folder, "diff", 48)
    return shares(P.kernel_shap(sampled.rows(), players.rows()))


def trunc_sql(value="max", tol="0.001*abs(full_value)", patience=1, samples=T):
    return q.with_(q.game("max"), q.ordered(samples, "perm"), q.path_values(value)) + f""",
br AS (SELECT *, CASE WHEN abs(full_value - value) <= {tol} THEN 0 ELSE 1 END AS away FROM pm),
il AS (SELECT *, sum(away) OVER (PARTITION BY game_id, sample ORDER BY pos) AS isl FROM br),
rn AS (SELECT *, sum(1 - away) OVER (PARTITION BY game_id, sample, isl ORDER BY pos) AS run FROM il),
tr AS (SELECT *, min(CASE WHEN run > {patience} THEN pos END) OVER (PARTITION BY game_id, sample) AS stop FROM rn)"""


def truncated_paths(spark, folder):
    paths = U.path_values(D.random_order(max_game(spark, folder), T, "perm"), U.max_cost())
    return E.truncate_paths(paths, 1e-3, True, 1)


@query("truncated_permutation_mean", trunc_sql() + f"""SELECT game_id, player, {q.tidy('avg(CASE WHEN stop IS NULL OR pos <= stop THEN marginal ELSE 0 END)')} AS share FROM tr GROUP BY 1, 2""")
def truncated_permutation_mean(spark, folder):
    return shares(E.truncated_mean(truncated_paths(spark, folder)))


@query("truncation_accounting", trunc_sql() + """,
ac AS (SELECT game_id, first(n) AS n, count(DISTINCT sample) AS m, count(*) FILTER (WHERE stop IS NULL OR pos <= stop) AS p,
  count(*) FILTER (WHERE pos = 1 AND stop IS NOT NULL) AS t FROM tr GROUP BY 1)
SELECT game_id, m AS permutations, p AS prefixes, t AS truncated, """ + q.tidy("t/CAST(m AS DOUBLE)", 6) + """ AS truncation_rate,
""" + q.tidy("p/CAST(m AS DOUBLE)", 6) + """ AS mean_prefix, p + 2 AS calls, CAST(n*24 + 2 - p - 2 AS BIGINT) AS unused_calls, CAST(m*n - p AS BIGINT) AS saved_calls FROM ac""")
def truncation_accounting(spark, folder):
    out = E.truncation_accounting(truncated_paths(spark, folder), F.col("n").cast("bigint") * T + 2)
    return out.withColumn("truncation_rate", tidy(F.col("truncation_rate"), 6)).withColumn("mean_prefix", tidy(F.col("mean_prefix"), 6))


MARGINAL_SQL = q.with_(q.game("max"), MARGINAL_COUNTS_SQL.replace("5*n + 1", "2*n*n + 1"), """dw AS (SELECT ct.game_id, ct.player, ct.n, ct.size, d AS draw FROM ct, unnest(range(0, ct.count)) r(d)),
pd AS (SELECT dw.*, pl.cost, row_number() OVER (PARTITION BY dw.game_id, dw.player, dw.size, dw.draw ORDER BY {k}, pl.player) AS pos
  FROM dw JOIN pl ON pl.game_id = dw.game_id AND pl.player <> dw.player),
vv AS (SELECT dw.game_id, dw.player, dw.n, dw.size, dw.draw, coalesce(max(pd.cost) FILTER (WHERE pos <= dw.size), 0) AS v
  FROM dw LEFT JOIN pd USING (game_id, player, size, draw) GROUP BY ALL)""".format(
    k=q.key("'strm'", "dw.game_id", "dw.player", "dw.size", "dw.draw", "pl.player")))


@query("stratified_marginal_mean", MARGINAL_SQL + """,
sm AS (SELECT vv.game_id, vv.player, vv.size, avg(greatest(vv.v, pl.cost) - vv.v) AS m, first(vv.n) AS n FROM vv JOIN pl USING (game_id, player) GROUP BY 1, 2, 3)
""" + f"SELECT game_id, player, {q.tidy('CASE WHEN count(*) = first(n) THEN sum(m)/first(n) END')} AS share FROM sm GROUP BY 1, 2")
def stratified_marginal_mean(spark, folder):
    """One sample per (player, size) cell and a few more; cells take along the costs of their game."""
    players = S.customer_orders(spark, folder).rows()
    counts = B.marginal_counts(players, (F.col("n") * F.col("n") * 4 + 2).cast("bigint"), "cells")
    draws = D.predecessor_samples(with_costs(counts, players), "strm")
    samples = draws.select("game_id", "player", "n", "size", before_value().alias("without_value"), F.get("own.cost", F.col("player")).alias("cost"))
    return shares(E.stratified_marginal(samples.withColumn("with_value", F.greatest("without_value", "cost"))))


def with_costs(counts, players):
    """Cells with the costs `own` of all players of their game, in a fixed number of partitions: they are about to multiply."""
    return counts.repartition(D.shuffle_partitions(), "game_id").join(large(in_a_row(players, "cost")), "game_id")


def before_value():
    """The dearest predecessor's cost, read from the costs `own` of the game in the same row; 0 without predecessors."""
    return F.coalesce(F.array_max(F.transform("predecessors", lambda p: F.get("own.cost", p))), F.lit(0).cast("bigint"))


@query("predecessor_samples", MARGINAL_SQL.replace("2*n*n + 1", "5*n + 1") + """SELECT game_id, player, CAST(size AS INTEGER) AS size, CAST(draw AS BIGINT) AS draw, v AS before_value FROM vv""")
def predecessor_samples(spark, folder):
    players = S.customer_orders(spark, folder).rows()
    counts = B.marginal_counts(players, F.col("n") * 10 + 2, "cells")
    draws = D.predecessor_samples(with_costs(counts, players), "strm")
    return draws.select("game_id", "player", "size", "draw", before_value().alias("before_value"))


def block_sql(source):
    return f""", rk AS (SELECT pl.*, {source}.design_block, {source}.sample, {source}.pos FROM {source} JOIN pl USING (game_id, player)),
{q.path_values()},
bm AS (SELECT game_id, player, design_block, avg(marginal) AS m FROM pm GROUP BY 1, 2, 3)
SELECT game_id, player, {q.tidy('avg(m)')} AS share, {q.tidy('CASE WHEN count(*) >= 2 THEN var_samp(m)/count(*) END')} AS mean_variance FROM bm GROUP BY 1, 2"""


def block_report(design, seed, spark, folder):
    players = max_game(spark, folder).rows().select("game_id", "player", "cost")
    paths = U.path_values(Split(design(D.with_own(games(spark, folder), players), 2, seed)), U.max_cost()).rows()
    out = E.block_mean(paths)
    return out.select("game_id", "player", tidy(F.col("share")).alias("share"), tidy(F.col("mean_variance")).alias("mean_variance"))


@query("latin_square_mean", q.with_(q.game("max"), GAMES_SQL, LATIN_SQL) + block_sql("ls"))
def latin_square_mean(spark, folder):
    return block_report(D.latin_square, "ls", spark, folder)


@query("component_array_mean", q.with_(q.game("max"), GAMES_SQL, ANY_FIELD_SQL, coa_rows_sql(2)) + block_sql("coa"))
def component_array_mean(spark, folder):
    return block_report(D.component_array, "coa", spark, folder)


@query("orthogonal_mean")
def orthogonal_mean(spark, folder):
    players = max_game(spark, folder).rows().select("game_id", "player", "cost")
    orders = D.reverse_pairs(D.with_own(G.orthogonal_orders(games(spark, folder), F.lit(8), "orth"), players))
    return shares(E.permutation_mean(U.path_values(Split(orders), U.max_cost())))


@query("antithetic_mean", q.with_(q.game("max"), q.ordered(12, "anti"), """rr AS (SELECT * EXCLUDE (pos, sample), sample AS pair, sample*2 + d AS sample, CASE WHEN d = 1 THEN n + 1 - pos ELSE pos END AS pos FROM rk, range(2) r(d)),
""" + q.path_values().replace("FROM rk", "FROM rr"), """am AS (SELECT *, CASE WHEN pos = 1 THEN single_value - empty_value WHEN pos = n THEN full_value - without_value ELSE marginal END AS x FROM pm),
pp AS (SELECT game_id, player, pair, avg(x) AS c FROM am GROUP BY 1, 2, 3)""") + f"SELECT game_id, player, {q.tidy('avg(c)')} AS share, {q.tidy('var_samp(c)/count(*)', 2)} AS mean_variance FROM pp GROUP BY 1, 2")
def antithetic_mean(spark, folder):
    paths = U.path_values(D.antithetic(max_game(spark, folder), 12, "anti"), U.max_cost())
    out = E.antithetic_mean(paths)
    return out.select("game_id", "player", tidy(F.col("share")).alias("share"), tidy(F.col("mean_variance"), 2).alias("mean_variance"))


@query("quadratic_shortcut", q.with_(q.game("max")) + f"SELECT game_id, player, {q.tidy('(single_value - empty_value + full_value - without_value)/2')} AS share FROM pl")
def quadratic_shortcut(spark, folder):
    return shares(E.quadratic_shortcut(max_game(spark, folder)))


@query("efficiency_projection", q.with_(q.game("max")) + f"""SELECT game_id, player, {q.tidy('w + (full_value - sum(w) OVER (PARTITION BY game_id))/n')} AS share
FROM (SELECT *, (single_value - empty_value + full_value - without_value)/2 AS w FROM pl) x""")
def efficiency_projection(spark, folder):
    raw = max_game(spark, folder).map(lambda df, hot: df.withColumn(
        "share", (F.col("single_value") - F.col("empty_value") + F.col("full_value") - F.col("without_value")) / 2))
    return shares(E.efficiency_offset(raw, F.col("full_value") - F.col("empty_value")).rows())


def attribute_query(method, per_player, places=4):
    def run(spark, folder):
        least = 4 if method in ("greedy_by_size", "complete_orbits", "coupled", "stratified", "orbit") else 1
        players = S.at_least(S.customer_orders(spark, folder), least)
        least_orbits = F.greatest(F.lit(per_player), F.col("n") - 3) if method == "complete_orbits" else per_player
        return shares(attribute(players, U.max_cost(), method, least_orbits, "api"), places)
    return run


for _m in ("greedy_by_size", "complete_orbits", "coupled", "stratified", "orbit"):
    query(f"attribute_{_m}")(attribute_query(_m, 3))

query("attribute_permutation", q.with_(q.game("max"), q.ordered(3, "api"), q.path_values()) + f"SELECT game_id, player, {q.tidy('avg(marginal)')} AS share FROM pm GROUP BY 1, 2")(
    attribute_query("permutation", 3))


@query("majority_permutation_mean", q.with_(q.game("vote"), q.ordered(T, "vote"), q.path_values("vote")) + f"SELECT game_id, player, {q.tidy('avg(marginal)', 6)} AS share FROM pm GROUP BY 1, 2")
def majority_permutation_mean(spark, folder):
    return shares(E.permutation_mean(U.path_values(D.random_order(vote_game(spark, folder), T, "vote"), U.weighted_majority())), 6)


# --- exact -------------------------------------------------------------------------------------

@query("basket_supplier_exact", f"""WITH pr AS (SELECT l_orderkey AS o, l_suppkey AS s, sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS part FROM lineitem GROUP BY 1, 2),
w AS (SELECT s, sum(part) OVER (PARTITION BY o) AS weight, count(*) OVER (PARTITION BY o) AS degree FROM pr)
SELECT CAST(0 AS BIGINT) AS game_id, CAST(s AS INTEGER) AS player, {q.tidy('sum(weight/CAST(degree AS DOUBLE))/100', 2)} AS share FROM w GROUP BY 2""")
def basket_supplier_exact(spark, folder):
    exact = X.term_shares(S.supplier_baskets(spark, folder))
    return shares(exact.withColumn("share", F.col("share") / 100), 2)


@query("basket_supplier_paths", """WITH pr AS (SELECT l_orderkey AS term_id, l_suppkey AS player, sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS part FROM lineitem GROUP BY 1, 2),
tm AS (SELECT term_id, player, sum(part) OVER (PARTITION BY term_id) AS weight FROM pr),
pl AS (SELECT 0 AS game_id, s_suppkey AS player FROM supplier),
""" + q.ordered(4, "basket") + """,
arr AS (SELECT sample, term_id, max_by(rk.player, pos) AS player, first(weight) AS weight FROM rk JOIN tm USING (player) GROUP BY 1, 2)
SELECT CAST(0 AS BIGINT) AS game_id, CAST(player AS INTEGER) AS player, """ + q.tidy("sum(weight)/4.0/100", 2) + " AS share FROM arr GROUP BY 2")
def basket_supplier_paths(spark, folder):
    suppliers = S.table(spark, folder, "supplier").select(F.lit(0).cast("bigint").alias("game_id"), F.col("s_suppkey").cast("int").alias("player"))
    players = suppliers.withColumn("n", F.lit(suppliers.count()))
    paths = D.random_order(Split(players), 4, "basket").rows()
    out = I.path_shares(paths, S.supplier_baskets(spark, folder), 4)
    return shares(out.withColumn("share", F.col("share") / 100), 2)


@query("channel_credit_exact", q.with_(CHANNEL_SQL) + f"SELECT game_id, ch.channel, {q.tidy('sum(weight/CAST(degree AS DOUBLE))/100')} AS share FROM tm JOIN ch USING (game_id, player) GROUP BY 1, 2")
def channel_credit_exact(spark, folder):
    players, terms = S.channel_game(spark, folder)
    exact = X.term_shares(terms).join(large(players.select("game_id", "player", "channel")), ["game_id", "player"])
    return exact.select("game_id", "channel", tidy(F.col("share") / 100).alias("share"))


FACTORIAL = "CASE WHEN mask & (1 << p) > 0 THEN factorial(CAST(greatest(s - 1, 0) AS INTEGER))*factorial(CAST(n - s AS INTEGER)) ELSE -factorial(CAST(s AS INTEGER))*factorial(CAST(greatest(n - s - 1, 0) AS INTEGER)) END/CAST(factorial(CAST(n AS INTEGER)) AS DOUBLE)"
EXHAUSTIVE_SQL = q.with_(PRIORITY_SQL, TABLE_SQL) + "SELECT game_id, CAST(p AS INTEGER) AS player, {v} AS share FROM tb, unnest(range(0, n)) r(p) GROUP BY 1, 2"


@query("exhaustive_shares", EXHAUSTIVE_SQL.format(v=q.tidy(f"sum({FACTORIAL}*top)")))
def exhaustive_shares(spark, folder):
    return shares(X.exhaustive_shares(subset_table(spark, folder, U.max_cost())))


@query("power_index", EXHAUSTIVE_SQL.format(v=q.tidy(f"sum({FACTORIAL}*win)", 6)))
def power_index(spark, folder):
    return shares(X.power_index(S.customer_priorities(spark, folder).rows().select("game_id", "player", "weight", "quota")), 6)


@query("customer_power_index")
def customer_power_index(spark, folder):
    return shares(X.power_index(S.customer_orders(spark, folder).rows().select("game_id", "player", "weight", "quota")), 6)


@query("mean_cost_by_size", q.with_(q.game("max"), """lv AS (SELECT game_id, n, cost, count(*) AS c FROM pl GROUP BY 1, 2, 3),
st AS (SELECT game_id, n, cost - coalesce(lag(cost) OVER w, 0) AS rise, CAST(coalesce(sum(c) OVER w - c, 0) AS BIGINT) AS low FROM lv WINDOW w AS (PARTITION BY game_id ORDER BY cost))""") + """
SELECT game_id, CAST(s AS BIGINT) AS size, """ + q.tidy("sum(rise*(1 - CASE WHEN s > low THEN 0 ELSE CAST(factorial(CAST(low AS INTEGER)) AS DOUBLE)/factorial(CAST(low - s AS INTEGER))*factorial(CAST(n - s AS INTEGER))/factorial(CAST(n AS INTEGER)) END))")
       + " AS mean_value FROM st, unnest(range(1, n + 1)) r(s) GROUP BY 1, 2")
def mean_cost_by_size(spark, folder):
    rows = S.customer_orders(spark, folder).rows().select("game_id", "cost")
    return X.mean_cost_by_size(rows).select("game_id", "size", tidy(F.col("mean_value")).alias("mean_value"))


@query("win_probability_by_size", q.with_(PRIORITY_SQL, TABLE_SQL) + f"SELECT game_id, CAST(s AS INTEGER) AS size, {q.tidy('avg(win)', 6)} AS probability FROM tb GROUP BY 1, 2")
def win_probability_by_size(spark, folder):
    out = X.win_probability_by_size(S.customer_priorities(spark, folder).rows().select("game_id", "player", "weight", "quota"))
    return out.select("game_id", "size", tidy(F.col("probability"), 6).alias("probability"))


@query("all_permutations_mean", EXHAUSTIVE_SQL.format(v=q.tidy(f"sum({FACTORIAL}*top)")))
def all_permutations_mean(spark, folder):
    """Every order of every customer's priorities (at most 120), averaged."""
    players = U.boundary(S.customer_priorities(spark, folder), U.max_cost()).rows()
    orders = D.all_orders(D.with_own(players.where("player = 0").select("game_id", "n"), players.select("game_id", "player", "cost")))
    return shares(E.permutation_mean(U.path_values(Split(orders), U.max_cost())))
