"""Designs, utilities, estimators and exact answers over the games of customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from allotment.catalog import sql as q
from allotment.catalog.registry import query
from allotment.functions.hashing import tidy
from allotment.functions.laws import INNER, KERNEL
from allotment.operators import designs as D
from allotment.operators import estimators as E
from allotment.operators import exact as X
from allotment.operators import utilities as U
from allotment.sources import tables as S

T = 24


def max_game(spark, folder, least=1):
    return U.boundary(S.at_least(S.customer_orders(spark, folder), least), U.max_cost())


def vote_game(spark, folder, least=1):
    return U.boundary(S.at_least(S.customer_orders(spark, folder), least), U.weighted_majority())


def shares(df, places=4):
    return df.select("game_id", "player", tidy(F.col("share"), places).alias("share"))


SHARES = f"SELECT game_id, player, {q.tidy('share')} AS share FROM "


# --- exact -------------------------------------------------------------------------------------

@query("order_cost_exact", q.with_(q.LINES, """lv AS (SELECT game_id, cost, count(*) AS c FROM ln GROUP BY 1, 2),
inc AS (SELECT game_id, cost, (cost - coalesce(lag(cost) OVER (PARTITION BY game_id ORDER BY cost), 0))
  / CAST(sum(c) OVER (PARTITION BY game_id ORDER BY cost DESC) AS DOUBLE) AS d FROM lv),
sh AS (SELECT game_id, cost, sum(d) OVER (PARTITION BY game_id ORDER BY cost) AS share FROM inc)""")
    + f"SELECT game_id, player, {q.tidy('share/100')} AS share FROM ln JOIN sh USING (game_id, cost)")
def order_cost_exact(spark, folder):
    lines = S.order_lines(spark, folder).rows()
    exact = X.airport_shares(lines.select("game_id", "player", "cost"))
    return shares(exact.withColumn("share", F.col("share") / 100))


EXACT_ORDERS = """lv AS (SELECT game_id, cost, count(*) AS c FROM pl GROUP BY 1, 2),
inc AS (SELECT game_id, cost, (cost - coalesce(lag(cost) OVER (PARTITION BY game_id ORDER BY cost), 0))
  / CAST(sum(c) OVER (PARTITION BY game_id ORDER BY cost DESC) AS DOUBLE) AS d FROM lv),
sh AS (SELECT game_id, cost, sum(d) OVER (PARTITION BY game_id ORDER BY cost) AS share FROM inc),
ex AS (SELECT game_id, player, share FROM pl JOIN sh USING (game_id, cost))"""


@query("customer_cost_exact", q.with_(q.game("max"), EXACT_ORDERS) + SHARES + "ex")
def customer_cost_exact(spark, folder):
    players = S.customer_orders(spark, folder).rows()
    return shares(X.airport_shares(players.select("game_id", "player", "cost")))


# --- permutation paths -------------------------------------------------------------------------

PATH_MEAN = """SELECT game_id, player, {s} AS share, {v} AS variance, {m} AS mean_variance
FROM (SELECT game_id, player, avg(marginal) AS share, var_samp(marginal) AS variance,
  var_samp(marginal)/count(*) AS mean_variance FROM pm GROUP BY 1, 2)""".format(
    s=q.tidy("share"), v=q.tidy("variance", 2), m=q.tidy("mean_variance", 2))


def path_report(df):
    return df.select("game_id", "player", tidy(F.col("share")).alias("share"),
                     tidy(F.col("variance"), 2).alias("variance"), tidy(F.col("mean_variance"), 2).alias("mean_variance"))


@query("full_permutation_mean", q.with_(q.game("max"), q.ordered(T, "perm"), q.path_values()) + PATH_MEAN)
def full_permutation_mean(spark, folder):
    return path_report(E.permutation_mean(U.path_values(D.random_order(max_game(spark, folder), T, "perm"), U.max_cost())))


@query("order_cost_paths", q.with_(q.LINES, q.ordered(8, "lines", "ln"), q.path_values())
       + f"SELECT game_id, player, {q.tidy('avg(marginal)/100')} AS share FROM pm GROUP BY 1, 2")
def order_cost_paths(spark, folder):
    paths = U.path_values(D.random_order(S.order_lines(spark, folder), 8, "lines"), U.max_cost())
    return shares(E.permutation_mean(paths).withColumn("share", F.col("share") / 100))


# --- group-by estimators -----------------------------------------------------------------------

GT_SQL = """gt AS (SELECT game_id, player, first(n) AS n, first(full_value) - first(empty_value) AS target,
  (SELECT sum(1.0/k) FROM unnest(range(1, first(ev.n))) r(k))*2 * sum(CASE WHEN inside THEN value - empty_value ELSE 0 END)/count(*) AS raw
  FROM ev GROUP BY 1, 2)"""


def harmonic_cte(name="hn", source="pl"):
    return f"{name} AS (SELECT n, coalesce(sum(1.0/k), 0) AS h FROM (SELECT DISTINCT n FROM {source}) d LEFT JOIN unnest(range(1, 200)) r(k) ON k < n GROUP BY 1)"


OFFSET = "sh AS (SELECT game_id, player, raw + (target - sum(raw) OVER (PARTITION BY game_id))/n AS share FROM es)"


@query("group_testing", q.with_(q.game("max", 2), q.ordered(T, "gt"), q.sizes(T, "gt", "kernel"), q.evaluated(), harmonic_cte(),
    """es AS (SELECT game_id, player, ev.n, first(full_value) - first(empty_value) AS target,
  2*first(h)*sum(CASE WHEN inside THEN value - empty_value ELSE 0 END)/count(*) AS raw FROM ev JOIN hn USING (n) GROUP BY 1, 2, 3)""",
    OFFSET) + SHARES + "sh")
def group_testing(spark, folder):
    return shares(E.group_testing(U.evaluate(D.iid_design(max_game(spark, folder, 2), T, "gt", KERNEL), U.max_cost())))


@query("gels", q.with_(q.game("max", 2), q.ordered(T, "gels"), q.sizes(T, "gels", "kernel"), q.evaluated(), harmonic_cte(),
    """es AS (SELECT game_id, player, ev.n, first(full_value) - first(empty_value) AS target,
  first(h)*coalesce(avg(value) FILTER (WHERE inside), 0) AS raw FROM ev JOIN hn USING (n) GROUP BY 1, 2, 3)""",
    OFFSET) + SHARES + "sh")
def gels(spark, folder):
    return shares(E.gels(U.evaluate(D.iid_design(max_game(spark, folder, 2), T, "gels", KERNEL), U.max_cost())))


@query("complementary", q.with_(q.game("max"), q.ordered(T, "cc"), q.sizes(T, "cc", "uniform"), q.evaluated(),
    """st AS (SELECT game_id, player, first(n) AS n, CASE WHEN inside THEN size ELSE n - size END AS stratum,
  avg(CASE WHEN inside THEN value - rest ELSE rest - value END) AS m FROM ev GROUP BY game_id, player, stratum)""")
    + f"SELECT game_id, player, {q.tidy('sum(m)/first(n)')} AS share FROM st GROUP BY 1, 2")
def complementary(spark, folder):
    sampled = D.complement_design(max_game(spark, folder), T, "cc")
    return shares(E.complementary(U.evaluate(sampled, U.max_cost(), with_rest=True)))


def inner_cost(spark, folder, seed, samples=T):
    players = E.boundary_part(max_game(spark, folder, 4))
    return U.evaluate(D.iid_design(players, samples, seed, INNER), U.max_cost())


def INNER_SQL(seed, samples=T):
    return q.with_(q.game("max", 4), q.BOUNDARY_SHARE, q.ordered(samples, seed, "bs"), q.sizes(samples, seed, "inner"), q.evaluated())


STRATA_SQL = """st AS (SELECT game_id, player, size, first(n) AS n, first(boundary_share) AS b, count(*) AS rws, sum(value) AS tot,
  count(*) FILTER (WHERE inside) AS k, sum(value) FILTER (WHERE inside) AS ins FROM ev GROUP BY 1, 2, 3)"""


@query("ratio_zero_filled", INNER_SQL("ratio") + "," + STRATA_SQL + f"""
SELECT game_id, player, {q.tidy('first(b) + sum(coalesce(ins/nullif(k,0),0) - coalesce((tot - coalesce(ins,0))/nullif(rws-k,0),0))/first(n)')} AS share
FROM st GROUP BY 1, 2""")
def ratio_zero_filled(spark, folder):
    return shares(E.ratio(inner_cost(spark, folder, "ratio"), "zero"))


@query("coupled_linear", INNER_SQL("lin") + """,
wt AS (SELECT *, (value - (empty_value + size*(full_value - empty_value)/n))*sqrt(n/CAST(size*(n-size) AS DOUBLE)) AS w FROM ev),
zz AS (SELECT DISTINCT n, z FROM law)""" + f"""
SELECT game_id, player, {q.tidy('first(boundary_share) + first(z)*sqrt(first(wt.n))*(sum(CASE WHEN inside THEN w ELSE 0 END) - sum(w*size/wt.n))/count(*)')} AS share
FROM wt JOIN zz USING (n) GROUP BY 1, 2""")
def coupled_linear(spark, folder):
    return shares(E.linear(inner_cost(spark, folder, "lin")))


