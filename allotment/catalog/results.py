"""Result analytics over sampled estimates of the customers' cost shares."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from allotment.catalog import sql as q
from allotment.catalog.diagnostics import tidied
from allotment.catalog.registry import query
from allotment.catalog.sampling import EXACT_ORDERS, max_game
from allotment.functions.hashing import tidy
from allotment.operators import analytics as A
from allotment.operators import designs as D
from allotment.operators import estimators as E
from allotment.operators import exact as X
from allotment.operators import utilities as U
from allotment.operators.skew import large
from allotment.sources.shared import cut

T, REPEATS, DRAWS = 24, 3, 40
SCREEN, HOLDOUT = "rep", "hold"  # seeds of the permutations that choose a method, and of those that confirm it
TOLERANCE = 0.25  # so coarse that truncated estimates lose some of the total and every report has a difference to show
GROUP = A.GROUP


def reference_paths(spark, folder, seed=SCREEN):
    """8 permutations per repeat, with and without truncation: the estimates all reports start from."""
    paths = U.path_values(D.random_order(max_game(spark, folder), T, seed), U.max_cost())
    kept = paths.map(lambda df, hot: df.withColumn("plain", F.col("marginal")))
    return E.truncate_paths(kept, TOLERANCE, True, 1)


def repeat_means(spark, folder, seed=SCREEN):
    """(game_id, player, repeat, p0, p1, t0, t1), the estimates of a repeat in a row, and whether some game is hot."""
    paths = reference_paths(spark, folder, seed)
    rows = paths.rows().withColumn("repeat", F.floor(F.col("sample") / 8).cast("int"))
    half = F.col("sample") % 8 < 4
    sums = rows.groupBy("game_id", "player", "repeat").agg(
        F.avg(F.when(half, F.col("plain"))).alias("p0"), F.avg("plain").alias("p1"),
        F.avg(F.when(half, F.col("marginal"))).alias("t0"), F.avg("marginal").alias("t1"))
    return sums, paths.hot is not None


def by_cell(means):
    """A row for every method and budget."""
    cell = lambda m, b, c: F.struct(F.lit(m).alias("method"), F.lit(b).alias("budget_index"), F.col(c).alias("value"))
    kept = [c for c in ("truth",) if c in means.columns]
    return means.select("game_id", "player", "repeat", F.inline(F.array(
        cell("plain", 0, "p0"), cell("plain", 1, "p1"), cell("truncated", 0, "t0"), cell("truncated", 1, "t1"))), *kept)


def estimates(spark, folder, seed=SCREEN):
    """(game_id, method, repeat, budget_index, player, value): 2 methods x 3 repeats x 2 budgets."""
    return by_cell(repeat_means(spark, folder, seed)[0])


def truth(spark, folder):
    from allotment.sources.tables import customer_orders
    return X.airport_shares(customer_orders(spark, folder).rows().select("game_id", "player", "cost"))


def scored_and_hot(spark, folder, seed=SCREEN):
    """Scored rows, and whether some game is hot. References are joined to rows of a repeat; these are dealt out by game, where
    no game is hot, before they become rows of methods and budgets: reports by cell, player or game need no further shuffle."""
    means, hot = repeat_means(spark, folder, seed)
    rows = A.score(means, truth(spark, folder))
    return by_cell(rows if hot else rows.repartition(D.shuffle_partitions(), "game_id")), hot


def scored(spark, folder, seed=SCREEN):
    return scored_and_hot(spark, folder, seed)[0]


def cells(spark, folder, seed=SCREEN):
    """The cell table, written once: reports read it several times."""
    return cut(A.cells(scored(spark, folder, seed)), "cells")


EST_SQL = q.with_(q.game("max"), q.ordered(T, SCREEN), q.path_values(), f"br AS (SELECT *, CASE WHEN abs(full_value - value) <= {TOLERANCE}*abs(full_value) THEN 0 ELSE 1 END AS away FROM pm)", """
il AS (SELECT *, sum(away) OVER (PARTITION BY game_id, sample ORDER BY pos) AS isl FROM br),
rn AS (SELECT *, sum(1 - away) OVER (PARTITION BY game_id, sample, isl ORDER BY pos) AS run FROM il),
tr AS (SELECT *, min(CASE WHEN run > 1 THEN pos END) OVER (PARTITION BY game_id, sample) AS stop FROM rn),
tm AS (SELECT *, CASE WHEN stop IS NULL OR pos <= stop THEN marginal ELSE 0 END AS tmar, CAST(sample//8 AS INTEGER) AS repeat FROM tr),
es AS (SELECT game_id, player, repeat, avg(marginal) FILTER (WHERE sample%8 < 4) AS p0, avg(marginal) AS p1, avg(tmar) FILTER (WHERE sample%8 < 4) AS t0, avg(tmar) AS t1 FROM tm GROUP BY 1, 2, 3),
el AS (SELECT game_id, player, repeat, 'plain' AS method, 0 AS budget_index, p0 AS value FROM es UNION ALL SELECT game_id, player, repeat, 'plain', 1, p1 FROM es
  UNION ALL SELECT game_id, player, repeat, 'truncated', 0, t0 FROM es UNION ALL SELECT game_id, player, repeat, 'truncated', 1, t1 FROM es)""", EXACT_ORDERS,
"""sc AS (SELECT el.*, ex.share AS truth FROM el JOIN ex USING (game_id, player)),
ce AS (SELECT game_id, method, repeat, budget_index, avg((value-truth)*(value-truth)) AS mse, sqrt(avg((value-truth)*(value-truth))) AS rmse, sum(value) AS total, sum(truth) AS target, avg(truth*truth) AS ts FROM sc GROUP BY 1, 2, 3, 4)""")


def by_group(items, source="ce", keys="game_id, method, budget_index", places=4):
    return " SELECT " + keys + ", " + ", ".join(f"{q.tidy(e, places)} AS {a}" for a, e in items) + f" FROM {source} GROUP BY {keys}"


@query("estimate_cells", EST_SQL + f"SELECT game_id, method, repeat, budget_index, player, {q.tidy('value')} AS value, {q.tidy('truth')} AS truth FROM sc")
def estimate_cells(spark, folder):
    return tidied(scored(spark, folder), [], 4)


@query("rmse_summary", EST_SQL + by_group([("aggregate_rmse", "sqrt(avg(mse))"), ("mean_rmse", "avg(rmse)"), ("sd_rmse", "stddev_samp(rmse)"), ("normalised_rmse", "sqrt(avg(mse))/sqrt(first(ts))")]))
def rmse_summary(spark, folder):
    return tidied(A.rmse_summary(cells(spark, folder)), [], 4)


@query("estimate_bias", EST_SQL + ", mb AS (SELECT game_id, method, budget_index, player, avg(value) - first(truth) AS b FROM sc GROUP BY 1, 2, 3, 4)" + by_group([("bias_l2", "sqrt(sum(b*b))"), ("bias_rmse", "sqrt(avg(b*b))")], "mb"))
def estimate_bias(spark, folder):
    return tidied(A.bias(scored(spark, folder)), [], 4)


@query("efficiency_gap", EST_SQL + by_group([("mean_gap", "avg(abs(total - target))"), ("max_gap", "max(abs(total - target))")]))
def efficiency_gap(spark, folder):
    return tidied(A.efficiency_gap(cells(spark, folder)), [], 4)


@query("noise_corrected_rmse", EST_SQL + ", nv AS (SELECT game_id, player, avg(marginal) AS truth2, var_samp(marginal)/count(*) AS mv FROM pm GROUP BY 1, 2), nc AS (SELECT el.*, value - truth2 AS g, mv FROM el JOIN nv USING (game_id, player))"
       + by_group([("corrected_rmse", "sqrt(greatest(0, avg(g*g) - avg(mv)))")], "nc"))
def noise_corrected_rmse(spark, folder):
    reference = E.permutation_mean(reference_paths(spark, folder).map(lambda df, hot: df.withColumn("marginal", F.col("plain"))))
    rows = A.score(estimates(spark, folder), reference)
    return tidied(A.noise_corrected(rows, reference), [], 4)


@query("relative_errors", EST_SQL + by_group([("average_relative", "avg(abs(value/truth - 1))"), ("maximum_relative", "max(abs(value/truth - 1))")], "sc", "game_id, method, repeat, budget_index"))
def relative_errors(spark, folder):
    return tidied(A.relative_errors(scored(spark, folder)), [], 4)


@query("normalised_rmse", EST_SQL + by_group([("normalised_rmse", "rmse/sqrt(ts)")], "ce", "game_id, method, repeat, budget_index, rmse, ts").replace("SELECT game_id, method, repeat, budget_index, rmse, ts,", "SELECT game_id, method, repeat, budget_index,"))
def normalised_rmse(spark, folder):
    out = cells(spark, folder).withColumn("normalised_rmse", F.col("rmse") / F.sqrt("truth_square"))
    return tidied(out.select(*A.CELL, "normalised_rmse"), [], 4)


RANKED = """, rk2 AS (SELECT *, rank() OVER (PARTITION BY game_id, method, repeat, budget_index ORDER BY value) + (count(*) OVER (PARTITION BY game_id, method, repeat, budget_index, value) - 1)/2.0 AS rv,
  rank() OVER (PARTITION BY game_id, method, repeat, budget_index ORDER BY truth) + (count(*) OVER (PARTITION BY game_id, method, repeat, budget_index, truth) - 1)/2.0 AS rt FROM sc),
sp AS (SELECT game_id, method, repeat, budget_index, CASE WHEN stddev_pop(rv) > 0 AND stddev_pop(rt) > 0 THEN corr(rv, rt) END AS rho FROM rk2 GROUP BY 1, 2, 3, 4)"""


@query("rank_correlation", EST_SQL + RANKED + f" SELECT game_id, method, budget_index, {q.tidy('avg(rho)')} AS mean_spearman, count(rho) AS defined FROM sp GROUP BY 1, 2, 3")
def rank_correlation(spark, folder):
    # Estimates are rounded first so that equal averages tie whatever the order of summation.
    rows, hot = scored_and_hot(spark, folder)
    rows = rows.withColumn("value", F.round("value", 6)).withColumn("truth", F.round("truth", 6))
    return tidied(A.rank_correlation(rows, wide=hot), [], 4)


ORACLE_ROUND = ("FROM sc),", "FROM (SELECT * REPLACE (round(value, 6) AS value, round(truth, 6) AS truth) FROM sc) r),")
from allotment.catalog.registry import ORACLES  # noqa: E402

ORACLES["rank_correlation"] = ORACLES["rank_correlation"].replace(*ORACLE_ROUND)


@query("top_overlap", EST_SQL + """, tp AS (SELECT *, row_number() OVER (PARTITION BY game_id, method, repeat, budget_index ORDER BY round(value, 6) DESC, player) <= 5 AS a,
  row_number() OVER (PARTITION BY game_id, method, repeat, budget_index ORDER BY round(truth, 6) DESC, player) <= 5 AS b FROM sc),
to1 AS (SELECT game_id, method, repeat, budget_index, count(*) FILTER (WHERE a AND b)/CAST(least(count(*), 5) AS DOUBLE) AS o FROM tp GROUP BY 1, 2, 3, 4)""" + by_group([("mean_top_overlap", "avg(o)")], "to1"))
def top_overlap(spark, folder):
    rows, hot = scored_and_hot(spark, folder)
    rows = rows.withColumn("value", F.round("value", 6)).withColumn("truth", F.round("truth", 6))
    return tidied(A.top_overlap(cut(rows, "scored") if hot else rows, wide=hot), [], 4)


BOOT = """, ar AS (SELECT game_id, method, budget_index, list(mse ORDER BY repeat) AS v, list(rmse ORDER BY repeat) AS rv FROM ce GROUP BY 1, 2, 3),
ix AS (SELECT d, {k} AS a, {k1} AS b, {k2} AS c FROM range({n}) r(d)),
bd AS (SELECT ar.*, d, (v[a+1] + v[b+1] + v[c+1])/3 AS m, (rv[a+1] + rv[b+1] + rv[c+1])/3 AS rm FROM ar, ix)""".format(
    n=DRAWS, k=q.key("'boot'", "d", "0") + " % 3", k1=q.key("'boot'", "d", "1") + " % 3", k2=q.key("'boot'", "d", "2") + " % 3")
PAIRED = BOOT + ", bp AS (SELECT x.game_id, x.budget_index, x.d, sqrt(x.m/nullif(y.m, 0)) AS ratio, x.rm - y.rm AS gap FROM bd x JOIN bd y USING (game_id, budget_index, d) WHERE x.method = 'truncated' AND y.method = 'plain')"


@query("bootstrap_rmse", EST_SQL + BOOT + by_group([("rmse_low", "quantile_cont(sqrt(m), 0.025)"), ("rmse_high", "quantile_cont(sqrt(m), 0.975)")], "bd"))
def bootstrap_rmse(spark, folder):
    return tidied(A.bootstrap_rmse(cells(spark, folder), DRAWS, "boot"), [], 4)


@query("bootstrap_change", EST_SQL + PAIRED + by_group([("change_low", "quantile_cont(ratio - 1, 0.025)"), ("change_high", "quantile_cont(ratio - 1, 0.975)"), ("reduction_low", "quantile_cont(100*(1 - ratio), 0.025)"),
                                                        ("reduction_high", "quantile_cont(100*(1 - ratio), 0.975)")], "bp", "game_id, budget_index"))
def bootstrap_change(spark, folder):
    return tidied(A.bootstrap_change(cells_clean(spark, folder), "truncated", "plain", DRAWS, "boot"), [], 4)


def cells_clean(spark, folder, seed=SCREEN):
    """Errors below rounding are exact zeros, so a ratio of two of them is not noise."""
    clean = F.when(F.col("mse") < 1e-18, 0.0).otherwise(F.col("mse"))
    return cells(spark, folder, seed).withColumn("mse", clean).withColumn("rmse", F.sqrt("mse"))


CLEAN_SQL = EST_SQL.replace("ce AS (SELECT", "ce0 AS (SELECT") + ", ce AS (SELECT * REPLACE (CASE WHEN mse < 1e-18 THEN 0 ELSE mse END AS mse, CASE WHEN mse < 1e-18 THEN 0 ELSE rmse END AS rmse) FROM ce0)"
ORACLES["bootstrap_change"] = ORACLES["bootstrap_change"].replace(EST_SQL, CLEAN_SQL)


@query("paired_rmse_difference", EST_SQL + PAIRED + """, fx AS (SELECT x.game_id, x.budget_index, avg(x.rmse - y.rmse) AS md, avg(CASE WHEN x.rmse - y.rmse > 0 THEN 1.0 ELSE 0 END) AS fl FROM ce x JOIN ce y USING (game_id, budget_index, repeat)
  WHERE x.method = 'truncated' AND y.method = 'plain' GROUP BY 1, 2), bq AS (SELECT * FROM bp JOIN fx USING (game_id, budget_index))""" + by_group([("mean_difference", "first(md)"), ("fraction_larger", "first(fl)"),
    ("difference_low", "quantile_cont(gap, 0.025)"), ("difference_high", "quantile_cont(gap, 0.975)")], "bq", "game_id, budget_index"))
def paired_rmse_difference(spark, folder):
    rows = cells(spark, folder).withColumn("rmse", F.round("rmse", 7))
    return tidied(A.paired_difference(rows, "truncated", "plain", DRAWS, "boot"), [], 4)


ORACLES["paired_rmse_difference"] = ORACLES["paired_rmse_difference"].replace("ce AS (SELECT game_id", "cz AS (SELECT game_id", 1).replace(
    "FROM sc GROUP BY 1, 2, 3, 4)", "FROM sc GROUP BY 1, 2, 3, 4), ce AS (SELECT * REPLACE (round(rmse, 7) AS rmse) FROM cz)", 1)

STATUS_SQL = """, cs AS (SELECT ce.*, CASE WHEN p.n < 4 THEN 'too_few_players' ELSE 'ok' END AS status, p.n FROM ce JOIN (SELECT game_id, n FROM pl WHERE player = 0) p USING (game_id))"""


def status_cells(spark, folder):
    """Cells with a status: games outside the design domain stay as failed rows."""
    from allotment.catalog.plans import games
    rows = cells_clean(spark, folder).join(large(games(spark, folder)), "game_id")
    return rows.withColumn("status", F.when(F.col("n") < 4, "too_few_players").otherwise("ok"))


@query("paired_outcomes", CLEAN_SQL + STATUS_SQL + """, po AS (SELECT x.game_id, x.budget_index, x.status = 'ok' AS u, CASE WHEN x.status = 'ok' THEN x.rmse - y.rmse END AS g,
  CASE WHEN x.status = 'ok' THEN CASE WHEN y.rmse = 0 THEN CASE WHEN x.rmse = 0 THEN 1.0 END ELSE x.rmse/y.rmse END END AS r FROM cs x JOIN cs y USING (game_id, budget_index, repeat) WHERE x.method = 'truncated' AND y.method = 'plain'),
pc AS (SELECT game_id, budget_index, count(*) FILTER (WHERE g < -1e-9) AS wins, count(*) FILTER (WHERE g > 1e-9) AS losses, count(*) FILTER (WHERE abs(g) <= 1e-9) AS ties, count(*) FILTER (WHERE NOT u) AS unavailable,
  count(*) AS reg, avg(g) AS md, avg(r) AS mr FROM po GROUP BY 1, 2) SELECT game_id, budget_index, wins, losses, ties, unavailable, """ + q.tidy("md") + " AS mean_difference, " + q.tidy("mr") + " AS mean_ratio, "
       + q.tidy("wins/CAST(reg AS DOUBLE)") + " AS win_rate, " + q.tidy("wins/CAST(nullif(wins + losses + ties, 0) AS DOUBLE)") + " AS available_win_rate FROM pc")
def paired_outcomes(spark, folder):
    return tidied(A.paired_outcomes(status_cells(spark, folder), "truncated", "plain", 1e-9), [], 4)


RATIO_SQL = """, rt AS (SELECT x.method, x.budget_index, CASE WHEN y.rmse = 0 THEN CASE WHEN x.rmse = 0 THEN 1.0 END ELSE x.rmse/y.rmse END AS r FROM ce x JOIN ce y USING (game_id, budget_index, repeat) WHERE y.method = 'plain')"""


@query("geometric_mean_ratio", CLEAN_SQL + RATIO_SQL + " SELECT method, budget_index, count(r) AS pairs, " + q.tidy("CASE WHEN min(r) = 0 THEN 0 ELSE exp(avg(ln(CASE WHEN r > 0 THEN r END))) END") + " AS geometric_mean FROM rt GROUP BY 1, 2")
def geometric_mean_ratio(spark, folder):
    rows = cells_clean(spark, folder)
    base = rows.where("method = 'plain'").select("game_id", "repeat", "budget_index", F.col("rmse").alias("base"))
    ratio = rows.join(large(base), ["game_id", "repeat", "budget_index"]).withColumn("r", A.safe_ratio(F.col("rmse"), F.col("base")))
    return tidied(ratio.groupBy("method", "budget_index").agg(F.count("r").alias("pairs"), A.geometric_mean(F.col("r")).alias("geometric_mean")), [], 4)


CONFIG_SQL = """, cf AS (SELECT game_id, method, budget_index, count(*) FILTER (WHERE status <> 'ok') AS failures, round(sqrt(avg(CASE WHEN status = 'ok' THEN mse END)), 6) AS score, 8*(budget_index+1)*first(n) AS cost FROM cs GROUP BY 1, 2, 3)"""


def configurations(spark, folder):
    ok = F.col("status") == "ok"
    return status_cells(spark, folder).groupBy(*GROUP).agg(
        F.sum((~ok).cast("bigint")).alias("failures"), F.round(F.sqrt(F.avg(F.when(ok, F.col("mse")))), 6).alias("score"),
        (8 * (F.first("budget_index") + 1) * F.first("n")).cast("bigint").alias("cost"))


@query("configuration_ranking", CLEAN_SQL + STATUS_SQL + CONFIG_SQL + " SELECT game_id, method, budget_index, CAST(failures AS BIGINT) AS failures, " + q.tidy("score") + """ AS score, CAST(cost AS BIGINT) AS cost,
  CAST(row_number() OVER (PARTITION BY game_id ORDER BY failures, score ASC NULLS LAST, cost, method, budget_index) AS INTEGER) AS rank FROM cf""")
def configuration_ranking(spark, folder):
    order = [F.asc("failures"), F.asc_nulls_last("score"), F.asc("cost"), F.asc("method"), F.asc("budget_index")]
    return tidied(A.rank_configurations(configurations(spark, folder), ["game_id"], order), [], 4)


@query("joint_selection", CLEAN_SQL + STATUS_SQL + CONFIG_SQL + """, js AS (SELECT method, budget_index, round(avg(score), 6) AS mean_score, max(score) AS worst, CAST(sum(cost) AS BIGINT) AS cost FROM cf WHERE failures = 0 GROUP BY 1, 2)
SELECT method, budget_index, """ + q.tidy("mean_score") + " AS mean_score, " + q.tidy("worst") + " AS worst_score, cost FROM js ORDER BY mean_score, worst, cost, method, budget_index LIMIT 1")
def joint_selection(spark, folder):
    """One configuration for all games: mean score, then worst game, then cost; games with failures do not count."""
    rows = configurations(spark, folder).where("failures = 0").groupBy("method", "budget_index").agg(
        F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("worst_score"), F.sum("cost").alias("cost"))
    return tidied(rows.orderBy("mean_score", "worst_score", "cost", "method", "budget_index").limit(1), [], 4)


HOLDOUT_SQL = CLEAN_SQL.replace(q.ordered(T, SCREEN), q.ordered(T, HOLDOUT))
SEED_SQL = "SELECT md5(concat_ws('|', '{}', o_custkey, r)) FROM (SELECT DISTINCT o_custkey FROM orders) o, range(3) t(r)"


@query("holdout_confirmation", "WITH ch AS (" + CLEAN_SQL + """, su AS (SELECT game_id, method, budget_index, sqrt(avg(mse)) AS r FROM ce GROUP BY 1, 2, 3)
SELECT budget_index, round(avg(r) FILTER (WHERE method = 'truncated'), 6) < round(avg(r) FILTER (WHERE method = 'plain'), 6) AS cheaper FROM su GROUP BY 1),
hd AS (""" + HOLDOUT_SQL + PAIRED + """ SELECT budget_index, d, exp(avg(ln(CASE WHEN ratio > 0 THEN ratio END))) AS g FROM bp GROUP BY 1, 2),
hg AS (SELECT budget_index, cheaper, CASE WHEN cheaper THEN g ELSE 1/g END AS g FROM hd JOIN ch USING (budget_index))
SELECT budget_index, CASE WHEN cheaper THEN 'truncated' ELSE 'plain' END AS locked_method, """ + ", ".join(f"{q.tidy(f'quantile_cont(g, {p})')} AS ratio_{a}" for a, p in [("low", 0.025), ("mid", 0.5), ("high", 0.975)])
       + ", " + q.tidy("quantile_cont(g, 0.975)") + " < 1 AS confirmed, (SELECT count(*) FROM (" + SEED_SQL.format(SCREEN) + " INTERSECT " + SEED_SQL.format(HOLDOUT) + ") x) AS shared_seeds FROM hg GROUP BY budget_index, cheaper")
def holdout_confirmation(spark, folder):
    """The method that screening locks for each budget, against the other one on permutations of other seeds.

    ratio: geometric mean over games of the paired RMSE ratio per bootstrap draw; confirmed: its interval lies below 1.
    shared_seeds counts the cell seeds (stage, game, repeat) that both stages drew with.
    """
    from allotment.catalog.plans import games
    from allotment.plans.budget import cell_seed
    mean = lambda m: F.round(F.avg(F.when(F.col("method") == m, F.col("aggregate_rmse"))), 6)
    chosen = A.rmse_summary(cells_clean(spark, folder)).groupBy("budget_index").agg((mean("truncated") < mean("plain")).alias("cheaper"))
    rows = A.draws(A.paired_arrays(cells_clean(spark, folder, HOLDOUT), "truncated", "plain"), F.size("mine"), DRAWS, "boot")
    ratio = F.sqrt(A.mean_at("mine") / F.nullif(A.mean_at("theirs"), F.lit(0.0)))
    per_draw = rows.withColumn("r", ratio).groupBy("budget_index", "draw").agg(F.exp(F.avg(F.log(F.when(F.col("r") > 0, F.col("r"))))).alias("g"))
    locked = per_draw.join(chosen, "budget_index").withColumn("g", F.when(F.col("cheaper"), F.col("g")).otherwise(1 / F.col("g")))
    out = locked.groupBy("budget_index", F.when(F.col("cheaper"), "truncated").otherwise("plain").alias("locked_method")).agg(
        F.percentile("g", F.lit(0.025)).alias("ratio_low"), F.percentile("g", F.lit(0.5)).alias("ratio_mid"), F.percentile("g", F.lit(0.975)).alias("ratio_high"))
    repeats = games(spark, folder).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    seeds = lambda stage: repeats.select(cell_seed(stage, F.col("game_id"), F.col("repeat")).alias("seed"))
    shared = seeds(SCREEN).join(seeds(HOLDOUT), "seed", "left_semi").agg(F.count("*").alias("shared_seeds"))
    return tidied(out, [], 4).withColumn("confirmed", F.col("ratio_high") < 1).join(F.broadcast(shared))  # one row


DESIGN_SQL = """, dp AS (SELECT game_id, CAST(sample//8 AS INTEGER) AS repeat, player, avg(pos) - (first(n) + 1)/2.0 AS g FROM rk GROUP BY 1, 2, 3),
de AS (SELECT game_id, repeat, round(sqrt(avg(g*g)), 6) AS design_error FROM dp GROUP BY 1, 2),
dx AS (SELECT method, budget_index, game_id, repeat, design_error, round(rmse, 6) AS rmse FROM ce JOIN de USING (game_id, repeat) WHERE design_error > 0 AND round(rmse, 6) > 0)"""


def design_errors(spark, folder):
    """Per repeat: how far mean positions are from the centre, beside the estimate error."""
    paths = reference_paths(spark, folder).rows().withColumn("repeat", F.floor(F.col("sample") / 8).cast("int"))
    gaps = paths.groupBy("game_id", "repeat", "player").agg((F.avg("pos") - (F.first("n") + 1) / 2).alias("g"))
    errors = gaps.groupBy("game_id", "repeat").agg(F.round(F.sqrt(F.avg(F.col("g") * F.col("g"))), 6).alias("design_error"))
    rows = cells_clean(spark, folder).withColumn("rmse", F.round("rmse", 6)).join(large(errors), ["game_id", "repeat"])
    return cut(rows.where("design_error > 0 and rmse > 0"), "design-errors")


@query("design_error_correlation", CLEAN_SQL + DESIGN_SQL + """, rk3 AS (SELECT *, rank() OVER (PARTITION BY method, budget_index ORDER BY design_error) + (count(*) OVER (PARTITION BY method, budget_index, design_error) - 1)/2.0 AS rx,
  rank() OVER (PARTITION BY method, budget_index ORDER BY rmse) + (count(*) OVER (PARTITION BY method, budget_index, rmse) - 1)/2.0 AS ry FROM dx)
SELECT method, budget_index, true AS defined, count(*) AS rows, """ + q.tidy("corr(log10(design_error), log10(rmse))") + " AS pearson_log10, " + q.tidy("corr(rx, ry)") + " AS spearman FROM rk3 GROUP BY 1, 2")
def design_error_correlation(spark, folder):
    return tidied(A.log_correlation(design_errors(spark, folder), ["method", "budget_index"], "design_error", "rmse"), [], 4)


@query("within_cell_correlation", CLEAN_SQL + DESIGN_SQL + """, wc AS (SELECT log10(design_error) - avg(log10(design_error)) OVER w AS cx, log10(rmse) - avg(log10(rmse)) OVER w AS cy FROM dx WINDOW w AS (PARTITION BY method, budget_index))
SELECT """ + q.tidy("corr(cx, cy)") + " AS within_correlation, count(*) AS rows FROM wc")
def within_cell_correlation(spark, folder):
    return tidied(A.centred_correlation(design_errors(spark, folder), ["method", "budget_index"], "design_error", "rmse"), [], 4)


@query("error_trend", CLEAN_SQL + DESIGN_SQL + " SELECT method, " + q.tidy("regr_slope(log10(rmse), log10(design_error))") + " AS slope, " + q.tidy("regr_intercept(log10(rmse), log10(design_error))") + " AS intercept FROM dx GROUP BY 1")
def error_trend(spark, folder):
    return tidied(A.log_trend(design_errors(spark, folder), ["method"], "design_error", "rmse"), [], 4)


@query("run_comparison", CLEAN_SQL + """, su AS (SELECT game_id, method, budget_index, sqrt(avg(mse)) AS r FROM ce GROUP BY 1, 2, 3),
cm AS (SELECT a.game_id, a.budget_index, a.r AS before, b.r AS after, CASE WHEN a.r = 0 THEN CASE WHEN b.r = 0 THEN 1.0 END ELSE b.r/a.r END AS ratio FROM su a JOIN su b USING (game_id, budget_index) WHERE a.method = 'plain' AND b.method = 'truncated')
SELECT game_id, budget_index, """ + ", ".join(f"{q.tidy(e)} AS {a}" for a, e in [("before", "before"), ("after", "after"), ("ratio", "ratio"), ("change", "ratio - 1")]) + " FROM cm")
def run_comparison(spark, folder):
    rows = A.rmse_summary(cells_clean(spark, folder))
    out = A.compare_runs(rows.where("method = 'plain'"), rows.where("method = 'truncated'"), ["game_id", "budget_index"], "aggregate_rmse")
    return tidied(out, [], 4)


@query("metric_audit", EST_SQL + """, su AS (SELECT game_id, method, budget_index, sqrt(avg(mse)) AS r FROM ce GROUP BY 1, 2, 3),
au AS (SELECT *, round(r, 1) AS st FROM su) SELECT game_id, method, budget_index, """ + q.tidy("r") + " AS expected, " + q.tidy("st") + " AS stored, 'differs' AS problem FROM au WHERE abs(st - r) > 0.0404321")
def metric_audit(spark, folder):
    """Recompute the RMSE from raw estimates and list stored values (a report rounded to one place) that are off."""
    summary = A.rmse_summary(cells(spark, folder))
    stored = summary.withColumn("aggregate_rmse", F.round("aggregate_rmse", 1))
    return tidied(A.audit_metrics(summary, stored, GROUP, "aggregate_rmse", 0.0404321), [], 4)


@query("grid_audit", EST_SQL + """, w AS (SELECT DISTINCT o_custkey AS game_id, m AS method, r AS repeat, b AS budget_index FROM orders, (VALUES ('plain'), ('truncated'), ('exact')) v1(m), (VALUES (0), (1), (2)) v2(r), (VALUES (0)) v3(b)),
h AS (SELECT game_id, method, repeat, budget_index, count(*) AS c FROM (SELECT DISTINCT game_id, method, repeat, budget_index FROM ce) x GROUP BY 1, 2, 3, 4)
SELECT game_id, method, repeat, budget_index, CASE WHEN c IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM w FULL JOIN h USING (game_id, method, repeat, budget_index) WHERE c IS NULL OR NOT EXISTS (SELECT 1 FROM w w2 WHERE w2.game_id = h.game_id AND w2.method = h.method AND w2.repeat = h.repeat AND w2.budget_index = h.budget_index)""")
def grid_audit(spark, folder):
    """Against a grid that expects a third method and only the first budget."""
    from allotment.catalog.plans import games
    grid = games(spark, folder).withColumn("method", F.explode(F.array(F.lit("plain"), F.lit("truncated"), F.lit("exact")))).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("budget_index", F.lit(0))
    return A.audit_grid(grid, cells(spark, folder), A.CELL)


@query("call_accounting_audit", EST_SQL + """, pc AS (SELECT game_id, repeat, sample, first(n) AS n, m AS method, CAST(count(*) FILTER (WHERE m = 'plain' OR stop IS NULL OR pos <= stop) AS BIGINT) AS calls FROM tm, (VALUES ('plain'), ('truncated')) v(m) GROUP BY 1, 2, 3, 5),
up AS (SELECT *, CAST(sum(calls) OVER (PARTITION BY game_id, method, repeat ORDER BY sample) AS BIGINT) + 2 AS spent FROM pc),
ca AS (SELECT game_id, method, repeat, CAST(6*first(n) + 2 AS BIGINT) AS target_calls, max(spent) AS actual_calls, count(*) FILTER (WHERE spent <= 6*n + 2) AS completed FROM up GROUP BY 1, 2, 3)
SELECT game_id, method, repeat, target_calls, actual_calls, actual_calls <= target_calls AS within_cap, CAST(completed AS BIGINT) AS completed FROM ca""")
def call_accounting_audit(spark, folder):
    """Calls of both methods for 8 permutations against a cap that pays for 6 whole ones, and how many of the 8 it would pay for."""
    from allotment.catalog.plans import games
    rows = reference_paths(spark, folder).rows().withColumn("repeat", F.floor(F.col("sample") / 8).cast("int"))
    calls = rows.groupBy("game_id", "repeat", "sample").agg(F.count("*").alias("plain"), F.sum(F.col("evaluated").cast("bigint")).alias("truncated"))
    runs = calls.select("game_id", "repeat", "sample", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("calls")) for m in ("plain", "truncated")])))
    order = Window.partitionBy("game_id", "method", "repeat").orderBy("sample")  # 8 rows each
    plan = games(spark, folder).select("game_id", (F.col("n") * 6 + 2).cast("bigint").alias("target_calls"))
    spent = runs.withColumn("spent", F.sum("calls").over(order) + 2).join(large(plan), "game_id")
    return spent.groupBy("game_id", "method", "repeat", "target_calls").agg(
        F.max("spent").alias("actual_calls"), F.sum((F.col("spent") <= F.col("target_calls")).cast("bigint")).alias("completed")).withColumn(
        "within_cap", F.col("actual_calls") <= F.col("target_calls"))


@query("overlap_audit", CLEAN_SQL + " SELECT game_id, method, repeat, budget_index FROM ce WHERE round(rmse, 5) IS DISTINCT FROM CASE WHEN repeat = 1 AND budget_index = 0 THEN round(rmse, 0) ELSE round(rmse, 5) END")
def overlap_audit(spark, folder):
    """Cells of a run against a saved copy with other timings, in which one repeat was edited to whole numbers."""
    rows = cells_clean(spark, folder).select(*A.CELL, F.round("rmse", 5).alias("rmse"), F.lit(1.0).alias("seconds"))
    edited = F.when((F.col("repeat") == 1) & (F.col("budget_index") == 0), F.round("rmse", 0)).otherwise(F.col("rmse"))
    return A.audit_overlap(rows, rows.withColumn("rmse", edited).withColumn("seconds", F.lit(2.0)), A.CELL, ["seconds"])


@query("merged_runs", EST_SQL + f"SELECT game_id, method, repeat, budget_index, {q.tidy('rmse')} AS rmse FROM ce")
def merged_runs(spark, folder):
    """Two runs that share a budget, merged to one copy of every cell."""
    rows = cells(spark, folder).select(*A.CELL, "rmse")
    first, second = rows.where("method = 'plain' or budget_index = 1"), rows.where("method = 'truncated' or budget_index = 0")
    return tidied(A.merge_runs([first, second], A.CELL), [], 4)


@query("sensitivity_summary", EST_SQL + """, lo AS (SELECT game_id, method, budget_index, 'rmse' AS metric, rmse AS x FROM ce UNION ALL SELECT game_id, method, budget_index, 'mse', mse FROM ce)
SELECT game_id, method, budget_index, metric, """ + q.tidy("avg(x)") + " AS mean, " + q.tidy("stddev_samp(x)") + " AS sd, count(*) AS rows FROM lo GROUP BY 1, 2, 3, 4")
def sensitivity_summary(spark, folder):
    return tidied(A.metric_summary(cells(spark, folder), GROUP, ["rmse", "mse"]), [], 4)


TIMES_SQL = "tt AS (SELECT user_id AS game_id, event_type AS method, value AS seconds FROM events)"


def timings(spark, folder):
    from allotment.sources.tables import table
    return table(spark, folder, "events").select(F.col("user_id").alias("game_id"), F.col("event_type").alias("method"), F.col("value").alias("seconds"))


@query("timing_summary", q.with_(TIMES_SQL) + "SELECT game_id, method, " + ", ".join(f"{q.tidy(e)} AS {a}" for a, e in [("mean", "avg(seconds)"), ("median", "quantile_cont(seconds, 0.5)"), ("fastest", "min(seconds)"), ("slowest", "max(seconds)")]) + ", count(*) AS rows FROM tt GROUP BY 1, 2")
def timing_summary(spark, folder):
    return tidied(A.timing_summary(timings(spark, folder), ["game_id", "method"], "seconds"), [], 4)


@query("modelled_time", q.with_(TIMES_SQL) + "SELECT game_id, method, " + q.tidy("count(*)*quantile_cont(seconds, 0.5) + max(seconds)") + " AS modelled_seconds FROM tt GROUP BY 1, 2")
def modelled_time(spark, folder):
    """Calls x median unit cost + design time, with a user's events as measured calls and the slowest as the design."""
    units = A.timing_summary(timings(spark, folder), ["game_id", "method"], "seconds")
    calls = timings(spark, folder).groupBy("game_id", "method").agg(F.count(F.lit(1)).alias("calls"), F.max("seconds").alias("design_seconds"))
    out = A.modelled_time(calls, units, ["game_id", "method"])
    return tidied(out.select("game_id", "method", "modelled_seconds"), [], 4)


@query("reference_quantiles", q.with_(q.game("max"), EXACT_ORDERS) + "SELECT game_id, " + ", ".join(f"{q.tidy(f'quantile_cont(abs(share), {p})')} AS q{int(p*100):02d}" for p in (0, 0.25, 0.5, 0.75, 1)) + " FROM ex GROUP BY 1")
def reference_quantiles(spark, folder):
    points = {f"q{int(p * 100):02d}": p for p in (0.0, 0.25, 0.5, 0.75, 1.0)}
    sizes = truth(spark, folder).select("game_id", F.abs("share").alias("size"))
    return tidied(A.exact_quantiles(sizes, ["game_id"], "size", points), [], 4)


@query("interpolated_error", CLEAN_SQL + """, su AS (SELECT game_id, method, sqrt(avg(mse) FILTER (WHERE budget_index = 0)) AS y0, sqrt(avg(mse) FILTER (WHERE budget_index = 1)) AS y1 FROM ce GROUP BY 1, 2)
SELECT game_id, method, CAST(6 AS DOUBLE) AS at, """ + q.tidy("exp(ln(y0) + (ln(6.0) - ln(4.0))/(ln(8.0) - ln(4.0))*(ln(y1) - ln(y0)))") + " AS interpolated FROM su WHERE y0 > 0 AND y1 > 0")
def interpolated_error(spark, folder):
    """The error curve between 4 and 8 permutations, read off at 6."""
    rows = A.rmse_summary(cells_clean(spark, folder)).where("aggregate_rmse > 0").withColumn("permutations", F.pow(F.lit(2.0), F.col("budget_index") + 2))
    return tidied(A.interpolate_log(rows, ["game_id", "method"], "permutations", "aggregate_rmse", F.lit(6)), [], 4)


MOMENT_SQL = q.with_(q.game("max"), q.ordered(12, "anti"), """rr AS (SELECT * EXCLUDE (pos, sample), sample AS pair, sample*2 + d AS sample, CASE WHEN d = 1 THEN n + 1 - pos ELSE pos END AS pos FROM rk, range(2) r(d)),
""" + q.path_values().replace("FROM rk", "FROM rr"), """pp AS (SELECT game_id, player, pair, avg(marginal) AS c FROM pm GROUP BY 1, 2, 3),
mm AS (SELECT game_id, player, count(*) AS count, sum(c) AS total, sum(c*c) AS squares, sum(CASE WHEN pair < 6 THEN c ELSE 0 END) AS first_total, CAST(count(*) FILTER (WHERE pair < 6) AS BIGINT) AS first_count FROM pp GROUP BY 1, 2),
ru AS (SELECT game_id, player, total/count AS value, sqrt(greatest((squares - count*(total/count)*(total/count))/(count - 1), 0)/count) AS se, first_total/first_count - (total - first_total)/(count - first_count) AS hg FROM mm)""")
# For 11 degrees of freedom P(|T| <= t) is a finite sum in a = atan(t/sqrt(11)); halving inverts it for every number of players.
CRITICAL_SQL = """,
cr AS (WITH RECURSIVE h(n, lo, hi, k) AS (SELECT DISTINCT n, CAST(0 AS DOUBLE), CAST(100 AS DOUBLE), 0 FROM pl UNION ALL
  SELECT n, CASE WHEN p < 1 - 0.05/n THEN t ELSE lo END, CASE WHEN p < 1 - 0.05/n THEN hi ELSE t END, k + 1 FROM (
  SELECT *, 2/pi()*(a + sin(a)*(cos(a) + 2/3.0*cos(a)^3 + 8/15.0*cos(a)^5 + 16/35.0*cos(a)^7 + 128/315.0*cos(a)^9)) AS p FROM (
  SELECT *, (lo + hi)/2 AS t, atan((lo + hi)/2/sqrt(11.0)) AS a FROM h WHERE k < 60) x) y)
  SELECT n, hi AS critical FROM h WHERE k = 60),
rc AS (SELECT ru.*, critical*se AS hw FROM ru JOIN (SELECT game_id, n FROM pl WHERE player = 0) g USING (game_id) JOIN cr USING (n))
"""


def pair_contributions(spark, folder):
    paths = U.path_values(D.antithetic(max_game(spark, folder), 12, "anti"), U.max_cost())
    return paths.rows().groupBy("game_id", "pair", "player").agg(F.avg("marginal").alias("contribution"))


@query("reference_uncertainty", MOMENT_SQL + CRITICAL_SQL + f"SELECT game_id, player, {q.tidy('value')} AS value, {q.tidy('se', 3)} AS standard_error, {q.tidy('hw', 3)} AS half_width, {q.tidy('hg')} AS half_gap FROM rc")
def reference_uncertainty(spark, folder):
    out = A.reference_uncertainty(A.reference_moments(pair_contributions(spark, folder), F.col("pair") < 6))
    return out.select("game_id", "player", tidy(F.col("value")).alias("value"), tidy(F.col("standard_error"), 3).alias("standard_error"),
                      tidy(F.col("half_width"), 3).alias("half_width"), tidy(F.col("half_gap")).alias("half_gap"))


@query("reference_summary", MOMENT_SQL + CRITICAL_SQL + f"SELECT game_id, {q.tidy('sqrt(avg(se*se))', 3)} AS rms_standard_error, {q.tidy('max(hw)', 3)} AS largest_half_width, {q.tidy('0.5*sqrt(avg(hg*hg))', 3)} AS half_split_rmse FROM rc GROUP BY 1")
def reference_summary(spark, folder):
    return tidied(A.reference_summary(A.reference_uncertainty(A.reference_moments(pair_contributions(spark, folder), F.col("pair") < 6))), [], 3)


@query("scope_comparison", CLEAN_SQL + PAIRED + """, su AS (SELECT game_id, budget_index, sqrt(avg(mse) FILTER (WHERE method = 'truncated')) AS mine, sqrt(avg(mse) FILTER (WHERE method = 'plain')) AS theirs FROM ce GROUP BY 1, 2),
ci AS (SELECT game_id, budget_index, quantile_cont(100*(1 - ratio), 0.025) AS lo, quantile_cont(100*(1 - ratio), 0.975) AS hi FROM bp GROUP BY 1, 2)
SELECT game_id, budget_index, """ + ", ".join(f"{q.tidy(e)} AS {a}" for a, e in [("candidate_rmse", "mine"), ("reference_rmse", "theirs"), ("reduction_low", "lo"), ("reduction_high", "hi")]) + " FROM su JOIN ci USING (game_id, budget_index)")
def scope_comparison(spark, folder):
    rows = cells_clean(spark, folder)
    pick = lambda m, name: F.sqrt(F.avg(F.when(F.col("method") == m, F.col("mse")))).alias(name)
    summary = rows.groupBy("game_id", "budget_index").agg(pick("truncated", "candidate_rmse"), pick("plain", "reference_rmse"))
    change = A.bootstrap_change(rows, "truncated", "plain", DRAWS, "boot").select("game_id", "budget_index", "reduction_low", "reduction_high")
    return tidied(summary.join(large(change), ["game_id", "budget_index"]), [], 4)


@query("size_profile", q.with_(q.game("max"), """lv AS (SELECT game_id, n, cost, count(*) AS c FROM pl GROUP BY 1, 2, 3),
st AS (SELECT game_id, n, cost - coalesce(lag(cost) OVER w, 0) AS rise, CAST(coalesce(sum(c) OVER w - c, 0) AS BIGINT) AS low FROM lv WINDOW w AS (PARTITION BY game_id ORDER BY cost))""", """mv AS (SELECT game_id, n, s,
sum(rise*(1 - CASE WHEN s > low THEN 0 ELSE CAST(factorial(CAST(low AS INTEGER)) AS DOUBLE)/factorial(CAST(low - s AS INTEGER))*factorial(CAST(n - s AS INTEGER))/factorial(CAST(n AS INTEGER)) END)) AS v FROM st, unnest(range(1, n + 1)) r(s) GROUP BY 1, 2, 3)""",
    q.law("inner"), "tp AS (SELECT DISTINCT game_id, full_value FROM pl)") + "SELECT game_id, CAST(mv.s AS BIGINT) AS size, " + ", ".join(f"{q.tidy(e)} AS {a}" for a, e in [("mean_value", "v"), ("line", "mv.s*full_value/n"), ("probability", "w/z")])
       + " FROM mv JOIN tp USING (game_id) JOIN law USING (n, s) WHERE n >= 4")
def size_profile(spark, folder):
    """Mean value by size, the straight line from v(empty) to v(all), and the probability of the size."""
    from allotment.catalog.plans import games
    from allotment.functions.laws import INNER
    players = max_game(spark, folder, 4).rows()
    means = X.mean_cost_by_size(players.select("game_id", "cost"))
    ends = players.where("player = 0").select("game_id", "n", "full_value")
    law = D.size_law_table(games(spark, folder), INNER).select("n", F.col("size").cast("bigint").alias("size"), "share")
    rows = means.join(large(ends), "game_id").join(law, ["n", "size"])
    return tidied(rows.select("game_id", "size", "mean_value", (F.col("size") * F.col("full_value") / F.col("n")).alias("line"), F.col("share").alias("probability")), [], 4)


@query("oracle_profile_gap", q.with_(q.game("max", 4), q.BOUNDARY_SHARE, q.ordered(T, "lin", "bs"), q.sizes(T, "lin", "inner"), q.evaluated()) + """,
pf AS (SELECT *, avg(value) OVER (PARTITION BY game_id, size) AS b FROM ev),
wt AS (SELECT *, (value - b)*sqrt(n/CAST(size*(n-size) AS DOUBLE)) AS w, (value - size*full_value/n)*sqrt(n/CAST(size*(n-size) AS DOUBLE)) AS w2 FROM pf),
zz AS (SELECT DISTINCT n, z FROM law), df AS (SELECT game_id, player, first(z)*sqrt(first(wt.n))/count(*)*((sum(CASE WHEN inside THEN w ELSE 0 END) - sum(w*size/wt.n)) - (sum(CASE WHEN inside THEN w2 ELSE 0 END) - sum(w2*size/wt.n))) AS g FROM wt JOIN zz USING (n) GROUP BY 1, 2)
SELECT game_id, """ + q.tidy("max(abs(g))") + " AS largest_gap FROM df GROUP BY 1")
def oracle_profile_gap(spark, folder):
    """Largest difference per game between the endpoint-line and the size-profile linear estimates."""
    from allotment.catalog.sampling import inner_cost
    sampled = E.with_size_profile(inner_cost(spark, folder, "lin"))
    both = E.linear_by(sampled, a="endpoint", b="profile").where("game_id is not null and player is not null")
    return tidied(both.groupBy("game_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_gap")), [], 4)


@query("score_matrix", EST_SQL + "SELECT game_id, budget_index, " + q.tidy("sqrt(avg(mse) FILTER (WHERE method = 'plain'))") + " AS plain, " + q.tidy("sqrt(avg(mse) FILTER (WHERE method = 'truncated'))") + " AS truncated FROM ce GROUP BY 1, 2")
def score_matrix(spark, folder):
    return tidied(A.score_matrix(cells(spark, folder), ["game_id", "budget_index"], "method", ["plain", "truncated"], F.sqrt(F.avg("mse"))), [], 4)


@query("status_summary", CLEAN_SQL + STATUS_SQL + "SELECT n, method, budget_index, count(*) AS registered, CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS successful, CAST(count(*) FILTER (WHERE status <> 'ok') AS BIGINT) AS failed, "
       + q.tidy("avg(CASE WHEN status = 'ok' THEN rmse END)") + " AS mean_ok, " + q.tidy("CASE WHEN min(status) = 'ok' AND max(status) = 'ok' THEN avg(rmse) END") + " AS mean_complete FROM cs GROUP BY 1, 2, 3")
def status_summary(spark, folder):
    return tidied(A.status_summary(status_cells(spark, folder), ["n", "method", "budget_index"], "rmse"), [], 4)


@query("comparison_table", CLEAN_SQL + STATUS_SQL + """, ct AS (SELECT n, method, budget_index, avg(rmse) AS m, stddev_samp(rmse) AS sd, count(*) AS cells FROM cs GROUP BY 1, 2, 3)
SELECT a.n, a.method, a.budget_index, """ + ", ".join(f"{q.tidy(e)} AS {a}" for a, e in [("mean_rmse", "a.m"), ("sd_rmse", "a.sd"), ("ratio_to_plain", "CASE WHEN b.m = 0 THEN CASE WHEN a.m = 0 THEN 1.0 END ELSE a.m/b.m END")]) + ", a.cells FROM ct a JOIN ct b USING (n, budget_index) WHERE b.method = 'plain'")
def comparison_table(spark, folder):
    """Games grouped by their number of players as the data set."""
    table = status_cells(spark, folder).groupBy("n", "method", "budget_index").agg(
        F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("sd_rmse"), F.count(F.lit(1)).alias("cells"))
    base = table.where("method = 'plain'").select("n", "budget_index", F.col("mean_rmse").alias("base"))
    out = table.join(base, ["n", "budget_index"]).withColumn("ratio_to_plain", A.safe_ratio(F.col("mean_rmse"), F.col("base")))
    return tidied(out.select("n", "method", "budget_index", "mean_rmse", "sd_rmse", "ratio_to_plain", "cells"), [], 4)
