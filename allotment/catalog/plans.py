"""Call budgets and grids over the games of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from allotment.catalog import sql as q
from allotment.catalog.registry import query
from allotment.functions.hashing import tidy
from allotment.functions.laws import INNER
from allotment.plans import budget as B
from allotment.sources import tables as S

MULTS = [2, 5, 10]
GAMES_SQL = "gm AS (SELECT o_custkey AS game_id, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1)"
GRID_SQL = GAMES_SQL + """,
gd0 AS (SELECT game_id, n, CAST(i AS INTEGER) AS budget_index, m AS multiplier FROM gm, (VALUES (0, 2), (1, 5), (2, 10)) v(i, m)),
gd AS (SELECT *, CAST(n*multiplier AS BIGINT) AS inner_calls, CAST(n*multiplier + 2*n + 2 AS BIGINT) AS total_calls FROM gd0)"""


def games(spark, folder):
    """One row per customer: a partial count, no numbering needed."""
    return S.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("game_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))


def grid(spark, folder):
    return B.budget_grid(games(spark, folder), MULTS)


@query("plan_budget_grid", q.with_(GRID_SQL) + "SELECT game_id, n, budget_index, multiplier, inner_calls, total_calls FROM gd")
def plan_budget_grid(spark, folder):
    return grid(spark, folder)


@query("plan_full_permutations", q.with_(GRID_SQL) + """SELECT game_id, budget_index,
  CAST(CASE WHEN n = 1 THEN 1 ELSE (total_calls - 2)//(n-1) END AS BIGINT) AS permutations,
  CAST(CASE WHEN n = 1 THEN 2 ELSE (total_calls - 2)//(n-1)*(n-1) + 2 END AS BIGINT) AS calls,
  CAST(CASE WHEN n = 1 THEN total_calls - 2 ELSE (total_calls - 2)%(n-1) END AS BIGINT) AS unused FROM gd""")
def plan_full_permutations(spark, folder):
    count, calls, unused = B.full_permutations(F.col("n"), F.col("total_calls"))
    return grid(spark, folder).select("game_id", "budget_index", count.alias("permutations"), calls.alias("calls"), unused.alias("unused"))


@query("plan_truncated_permutations", q.with_(GRID_SQL) + """SELECT game_id, budget_index, CAST((total_calls - 2)//n AS BIGINT) AS permutations,
  CAST((total_calls - 2)//n*n + 2 AS BIGINT) AS reserved, CAST((total_calls - 2)%n AS BIGINT) AS remainder FROM gd""")
def plan_truncated_permutations(spark, folder):
    count, reserved, left = B.truncated_permutations(F.col("n"), F.col("total_calls"))
    return grid(spark, folder).select("game_id", "budget_index", count.alias("permutations"), reserved.alias("reserved"), left.alias("remainder"))


@query("plan_orthogonal", q.with_(GRID_SQL, """op AS (SELECT *, CASE WHEN n > 1 THEN (total_calls - 2)//(2*greatest(n-1,1)) ELSE 0 END AS pairs FROM gd)""")
       + """SELECT game_id, budget_index, CAST(2*pairs AS BIGINT) AS permutations, CAST(pairs//greatest(n-1,1) AS BIGINT) AS full_blocks,
  CAST(pairs%greatest(n-1,1) AS BIGINT) AS tail_pairs, CAST(2*pairs*(n-1) + 2 AS BIGINT) AS calls FROM op""")
def plan_orthogonal(spark, folder):
    plan = B.orthogonal_plan(F.col("n"), F.col("total_calls"))
    return grid(spark, folder).select("game_id", "budget_index", *[c.alias(k) for k, c in plan.items()])


# Prime powers, enough for the customers' games.
PRIME_POWERS = [2, 3, 4, 5, 7, 8, 9, 11, 13, 16, 17, 19, 23, 25, 27, 29, 31, 32, 37, 41, 43, 47, 49, 53, 59, 61, 64]
PP_SQL = "pp AS (SELECT n, (SELECT min(p) FROM (VALUES " + ", ".join(f"({p})" for p in PRIME_POWERS) + ") v(p) WHERE p >= d.n) AS q FROM (SELECT DISTINCT n FROM gm) d)"


def _block_sql(method):
    rows = "n" if method == "ls" else "q*(q-1)"
    return q.with_(GRID_SQL, PP_SQL, f"bp AS (SELECT gd.*, CAST({rows} AS BIGINT) AS r, CAST({rows}*(n-1) AS BIGINT) AS c FROM gd JOIN pp USING (n))",
                   "bq AS (SELECT *, CASE WHEN c > 0 THEN (total_calls - 2)//c ELSE 0 END AS b FROM bp)") + """
SELECT game_id, budget_index, r AS rows_per_block, CAST(b AS BIGINT) AS blocks,
  CAST(CASE WHEN b > 0 OR n = 1 THEN b*c + 2 ELSE 0 END AS BIGINT) AS calls,
  CASE WHEN b > 0 OR n = 1 THEN 'ok' ELSE 'budget_infeasible' END AS status FROM bq"""


def _block_plan(method):
    def run(spark, folder):
        plan = B.block_plan(F.col("n"), F.col("total_calls"), method)
        return grid(spark, folder).select("game_id", "budget_index", *[c.alias(k) for k, c in plan.items()])
    return run


query("plan_latin_blocks", _block_sql("ls"))(_block_plan("ls"))
query("plan_component_array_blocks", _block_sql("coa"))(_block_plan("coa"))


@query("plan_complement_pairs", q.with_(GRID_SQL) + """SELECT game_id, budget_index, CAST(total_calls//2 AS BIGINT) AS pairs,
  CAST(total_calls//2*2 AS BIGINT) AS calls, CAST(total_calls%2 AS BIGINT) AS unused, total_calls%2 = 0 AS even FROM gd""")
def plan_complement_pairs(spark, folder):
    plan = B.complement_plan(F.col("total_calls"))
    return grid(spark, folder).select("game_id", "budget_index", *[c.alias(k) for k, c in plan.items()])


MARGINAL_COUNTS_SQL = "mc AS (SELECT p.game_id, p.player, p.n, CAST(s AS INTEGER) AS size, row_number() OVER (PARTITION BY p.game_id ORDER BY " + q.key(
    "'cells'", "'cell'", "p.game_id", "p.player", "s") + ", p.player, s) AS rk FROM pl p, unnest(range(0, p.n)) r(s)),\n" + """
ct AS (SELECT game_id, player, n, size, CAST(((5*n + 1)//(n*n)) + CASE WHEN rk <= (5*n + 1)%(n*n) THEN 1 ELSE 0 END AS BIGINT) AS count FROM mc)"""


@query("plan_marginal_counts", q.with_(q.game("max"), MARGINAL_COUNTS_SQL) + "SELECT game_id, player, size, count FROM ct")
def plan_marginal_counts(spark, folder):
    players = S.customer_orders(spark, folder).rows()
    counts = B.marginal_counts(players, F.col("n") * 10 + 2, "cells")
    return counts.select("game_id", "player", "size", "count")


MIN_ONE_SQL = """wq AS (SELECT game_id, n, CAST(s AS INTEGER) AS size, 2*n AS t, 1.0/sqrt(CAST(s*(n-s) AS DOUBLE)) AS w FROM gm, unnest(range(2, n-1)) r(s) WHERE n >= 4),
tg AS (SELECT *, t*w/sum(w) OVER (PARTITION BY game_id) AS target FROM wq),
st AS (SELECT *, greatest(1, CAST(floor(target) AS BIGINT)) AS c0 FROM tg),
tt AS (SELECT *, sum(c0) OVER (PARTITION BY game_id) AS tot FROM st),
stp AS (SELECT tt.*, k, CASE WHEN tot < t THEN target - c0 ELSE c0 - k - target END AS gain
  FROM tt, unnest(range(0, CASE WHEN tot < t THEN 1 ELSE c0 - 1 END)) r(k)),
rkd AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY gain DESC, size, k) AS rk FROM stp),
ad AS (SELECT game_id, size, count(*) AS a FROM rkd WHERE rk <= abs(t - tot) GROUP BY 1, 2),
mo AS (SELECT tt.game_id, n, size, target, CAST(c0 + coalesce(a, 0)*CASE WHEN tot < t THEN 1 ELSE -1 END AS BIGINT) AS count FROM tt LEFT JOIN ad USING (game_id, size))"""


@query("plan_minimum_one_counts", q.with_(GAMES_SQL, MIN_ONE_SQL) + f"SELECT game_id, size, {q.tidy('target', 6)} AS target, count FROM mo")
def plan_minimum_one_counts(spark, folder):
    counts = B.minimum_one_counts(games(spark, folder).where("n >= 4"), F.col("n") * 2, INNER)
    return counts.select("game_id", "size", tidy(F.col("target"), 6).alias("target"), "count")


@query("plan_per_player_rows", q.with_(GAMES_SQL) + """SELECT game_id, mode, CAST(CASE WHEN mode IN ('orbit', 'complete_orbits') THEN 7 ELSE 7*n END AS BIGINT) AS design_rows
FROM gm, (VALUES ('iid'), ('coupled'), ('stratified'), ('greedy_by_size'), ('orbit'), ('complete_orbits')) v(mode)""")
def plan_per_player_rows(spark, folder):
    modes = ["iid", "coupled", "stratified", "greedy_by_size", "orbit", "complete_orbits"]
    rows = games(spark, folder).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return rows.select("game_id", "mode", B.per_player_rows(F.col("n"), F.lit(7), F.col("mode")).alias("design_rows"))


@query("plan_tuning_grid", q.with_(GAMES_SQL) + """SELECT DISTINCT game_id, lambda0, candidate_pool FROM (
  SELECT game_id, CASE WHEN k = 1 THEN CAST(1.0 AS DOUBLE) ELSE CAST(l AS DOUBLE) END AS lambda0, CAST(k AS INTEGER) AS candidate_pool
  FROM gm, (VALUES (0.0), (0.25), (1.0), (4.0)) a(l), (VALUES (1), (2), (4), (8), (16)) b(k)
  UNION ALL SELECT game_id, CAST(1.0 AS DOUBLE), 4 FROM gm) u""")
def plan_tuning_grid(spark, folder):
    return B.tuning_grid(games(spark, folder), [0.0, 0.25, 1.0, 4.0], [1, 2, 4, 8, 16])


@query("plan_sensitivity_grid", q.with_(GAMES_SQL) + """SELECT game_id, CAST(0.0625 AS DOUBLE) AS lambda0, k AS candidate_pool FROM gm, (VALUES (8), (16), (32), (64), (128)) b(k)
UNION SELECT game_id, CAST(l AS DOUBLE), 64 FROM gm, (VALUES (0.015625), (0.03125), (0.0625), (0.125), (0.25), (0.5), (1.0)) a(l)""")
def plan_sensitivity_grid(spark, folder):
    return B.one_at_a_time_grid(games(spark, folder), [1/64, 1/32, 1/16, 1/8, 1/4, 1/2, 1.0], [8, 16, 32, 64, 128])


@query("plan_cell_seeds", q.with_(GRID_SQL) + """SELECT game_id, budget_index, r AS repeat, method, md5(concat_ws('|', 'base', game_id, r, budget_index, method)) AS seed
FROM gd, (VALUES (0), (1), (2)) a(r), (VALUES ('iid'), ('greedy')) b(method)""")
def plan_cell_seeds(spark, folder):
    cells = grid(spark, folder).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn(
        "method", F.explode(F.array(F.lit("iid"), F.lit("greedy"))))
    return cells.select("game_id", "budget_index", "repeat", "method",
                        B.cell_seed("base", F.col("game_id"), F.col("repeat"), F.col("budget_index"), F.col("method")).alias("seed"))
