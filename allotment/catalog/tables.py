"""Sources, sinks, splits, saved runs and learned utilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from allotment.catalog import sql as q
from allotment.catalog.diagnostics import tidied
from allotment.catalog.plans import GRID_SQL, grid
from allotment.catalog.registry import query
from allotment.catalog.results import CLEAN_SQL, EST_SQL, cells, cells_clean
from allotment.catalog.sampling import EXACT_ORDERS, max_game
from allotment.functions.hashing import order_key, tidy
from allotment.operators import analytics as A
from allotment.operators import designs as D
from allotment.operators import exact as X
from allotment.operators import learning as L
from allotment.operators.skew import Split
from allotment.sources import features as P
from allotment.sources import results as R
from allotment.sources import tables as S
from allotment.sources.shared import scratch

SHARDS, SAMPLES = 20, 24


def points(spark, folder):
    e = S.table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))


@query("feature_scan", "SELECT vec_id AS point_id, label, CAST(len(embedding) AS INTEGER) AS dimensions, " + q.tidy("list_sum([CAST(x AS DOUBLE) FOR x IN embedding])") + " AS total FROM embeddings")
def feature_scan(spark, folder):
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return points(spark, folder).select("point_id", "label", F.size("features").alias("dimensions"), tidy(total).alias("total"))


RANK_SQL = """pt AS (SELECT vec_id AS point_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS features, {k} AS key FROM embeddings),
rn AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key, point_id) AS rank, count(*) OVER (PARTITION BY label) AS rows FROM pt)"""


def ranks(seed):
    return RANK_SQL.format(k=q.key(f"'{seed}'", "vec_id"))


@query("balanced_subset", q.with_(ranks("sub")) + "SELECT point_id, label, CAST(rank AS INTEGER) AS rank, rows FROM rn WHERE rank <= 10")
def balanced_subset(spark, folder):
    return P.balanced_subset(points(spark, folder).drop("features"), 10, "sub")


@query("stratified_split", q.with_(ranks("split")) + "SELECT point_id, label, CASE WHEN rank <= ceil(0.2*rows) THEN 'test' ELSE 'train' END AS split FROM rn")
def stratified_split(spark, folder):
    return P.stratified_split(points(spark, folder).drop("features"), 0.2, "split").select("point_id", "label", "split")


@query("round_robin_split", q.with_(ranks("deal")) + """, dl AS (SELECT *, row_number() OVER (ORDER BY rank, label) AS place FROM rn)
SELECT point_id, label, place, CASE WHEN place <= 120 THEN 'valued' ELSE 'performance' END AS role FROM dl WHERE place <= 200""")
def round_robin_split(spark, folder):
    return P.round_robin_split(points(spark, folder).drop("features"), 120, 80, "deal")


SPLIT_SQL = ranks("split") + ", sl AS (SELECT *, CASE WHEN rank <= ceil(0.2*rows) THEN 'test' ELSE 'train' END AS split FROM rn)"


def split_points(spark, folder):
    ids = P.stratified_split(points(spark, folder).drop("features"), 0.2, "split").select("point_id", "split")
    return points(spark, folder).join(ids, "point_id")


@query("standardised_features", q.with_(SPLIT_SQL) + """, lg AS (SELECT point_id, split, unnest(range(0, len(features))) AS feature, unnest(features) AS x FROM sl),
ft AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS sd FROM lg WHERE split = 'train' GROUP BY 1 HAVING round(stddev_pop(x), 9) > 0)
SELECT point_id, split, CAST(feature AS INTEGER) AS feature, """ + q.tidy("(x - m)/sd") + " AS z FROM lg JOIN ft USING (feature)")
def standardised_features(spark, folder):
    out = P.standardise(split_points(spark, folder))
    pairs = out.select("point_id", "split", F.inline(F.arrays_zip(F.col("kept").alias("feature"), F.col("features").alias("z"))))
    return pairs.select("point_id", "split", "feature", tidy(F.col("z")).alias("z"))


@query("csv_round_trip", q.with_(q.game("max"), EXACT_ORDERS) + f"SELECT game_id, player, {q.tidy('share')} AS share FROM ex")
def csv_round_trip(spark, folder):
    exact = X.airport_shares(S.customer_orders(spark, folder).rows().select("game_id", "player", "cost"))
    return R.write_csv(exact.select("game_id", "player", tidy(F.col("share")).alias("share")), scratch(spark, "exact-values"))


DONE_SQL = ", dn AS (SELECT o_custkey AS game_id, CAST(count(*) % 3 AS INTEGER) AS budget_index FROM orders GROUP BY 1)"


@query("pending_cells", q.with_(GRID_SQL) + DONE_SQL + " SELECT game_id, budget_index, total_calls FROM gd WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.game_id = gd.game_id AND dn.budget_index = gd.budget_index)")
def pending_cells(spark, folder):
    """The saved run holds one budget of every game; the other two are still to do."""
    from allotment.catalog.plans import games
    config = R.config_hash("permutation", 24)
    done = games(spark, folder).select("game_id", (F.col("n") % 3).alias("budget_index")).withColumn("config", config)
    return R.pending_cells(grid(spark, folder), done, ["game_id", "budget_index"], config).select("game_id", "budget_index", "total_calls")


@query("reused_cells", EST_SQL + "SELECT game_id, method, repeat, budget_index, " + q.tidy("round(rmse, 2)", 2) + " AS rmse FROM ce WHERE budget_index = 1 AND abs(round(rmse, 2) - rmse) <= 0.0040404")
def reused_cells(spark, folder):
    """Cells of the larger budget whose stored (rounded) RMSE agrees with the raw estimates."""
    fresh = cells(spark, folder).select(*A.CELL, "rmse")
    saved = fresh.withColumn("rmse", F.round("rmse", 2))
    out = R.reuse_cells(saved, fresh.where("budget_index = 1"), fresh, A.CELL, "rmse", 0.0040404)
    return tidied(out, [], 2)


@query("merged_report", CLEAN_SQL + ", " + GRID_SQL + """, su AS (SELECT game_id, method, budget_index, sqrt(avg(mse)) AS r FROM ce GROUP BY 1, 2, 3),
ex3 AS (SELECT game_id, budget_index, m AS method, n >= 4 AS feasible FROM gd, (VALUES ('plain'), ('truncated')) v(m))
SELECT ex3.game_id, ex3.budget_index, ex3.method, """ + q.tidy("r") + """ AS aggregate_rmse, CASE WHEN NOT feasible THEN 'budget_infeasible' WHEN su.game_id IS NOT NULL THEN 'complete' ELSE 'pending' END AS status
FROM ex3 LEFT JOIN su USING (game_id, budget_index, method)""")
def merged_report(spark, folder):
    summary = A.rmse_summary(cells_clean(spark, folder)).select(*A.GROUP, "aggregate_rmse")
    reports = [summary.where("method = 'plain'"), summary.where("method = 'truncated'")]
    wanted = grid(spark, folder).withColumn("method", F.explode(F.array(F.lit("plain"), F.lit("truncated")))).withColumn("feasible", F.col("n") >= 4)
    out = R.merge_reports(wanted.select("game_id", "budget_index", "method", "feasible"), reports, ["game_id", "budget_index", "method"])
    return tidied(out, [], 4)


# --- learned utilities: value of data shards ---------------------------------------------------

SHARD_SQL = SPLIT_SQL + f""", tr0 AS (SELECT *, {q.key("'shard'", "point_id")} % {SHARDS} AS player FROM sl WHERE split = 'train'),
pl AS (SELECT 0 AS game_id, CAST(p AS INTEGER) AS player, {SHARDS} AS n FROM range({SHARDS}) r(p)),
{q.ordered(SAMPLES, 'shards')},
{q.sizes(SAMPLES, 'shards', 'uniform')},
mb AS (SELECT sample, player FROM rk JOIN sz USING (game_id, sample) WHERE pos <= size),
lg AS (SELECT player, label, unnest(range(0, len(features))) AS feature, unnest(features) AS x FROM tr0),
ctr AS (SELECT sample, label, feature, avg(x) AS c FROM mb JOIN lg USING (player) GROUP BY 1, 2, 3),
tst AS (SELECT point_id, label, unnest(range(0, len(features))) AS feature, unnest(features) AS x FROM sl WHERE split = 'test'),
dst AS (SELECT sample, point_id, tst.label, ctr.label AS guess, round(sum((x - c)*(x - c)), 9) AS d FROM tst JOIN ctr USING (feature) GROUP BY 1, 2, 3, 4),
hit AS (SELECT sample, point_id, first(label) AS label, arg_min(guess, (d, guess)) AS guess FROM dst GROUP BY 1, 2)"""


def shard_tables(spark, folder):
    """(train rows with their shard, test rows, member rows of sampled shard coalitions)."""
    rows = split_points(spark, folder)
    train = rows.where("split = 'train'").withColumn("player", (order_key("shard", F.col("point_id")) % SHARDS).cast("int"))
    # The shards themselves come from the data: every shard that holds a training row.
    shards = train.select("player").distinct().select(F.lit(0).cast("bigint").alias("game_id"), "player", F.lit(SHARDS).alias("n"))
    members = D.complement_design(Split(shards), SAMPLES, "shards").rows().where("inside")
    return train, rows.where("split = 'test'"), members


@query("shard_centroid_accuracy", q.with_(SHARD_SQL) + "SELECT sample, count(*) FILTER (WHERE label = guess) AS hits, count(*) AS points, " + q.tidy("count(*) FILTER (WHERE label = guess)/CAST(count(*) AS DOUBLE)") + " AS value FROM hit GROUP BY 1")
def shard_centroid_accuracy(spark, folder):
    train, test, members = shard_tables(spark, folder)
    models = L.centroids(members, L.shard_sums(train))
    return tidied(L.centroid_accuracy(test.select("label", "features"), models, SAMPLES), [], 4)


@query("empty_coalition_accuracy", q.with_(SPLIT_SQL) + "SELECT " + q.tidy("max(c)/CAST(sum(c) AS DOUBLE)") + " AS value FROM (SELECT count(*) AS c FROM sl WHERE split = 'test' GROUP BY label) x")
def empty_coalition_accuracy(spark, folder):
    return tidied(L.best_constant(split_points(spark, folder).where("split = 'test'")), [], 4)


@query("shard_logistic_accuracy")
def shard_logistic_accuracy(spark, folder):
    train, test, members = shard_tables(spark, folder)
    labels = L.classes(train, test)
    models = L.logistic_models(members, train, labels, "fit", one_pass=False)
    return L.logistic_scores(test.select("label", "features"), models, labels, SAMPLES).select("sample", tidy(F.col("accuracy")).alias("value"))


@query("shard_one_pass_likelihood")
def shard_one_pass_likelihood(spark, folder):
    train, test, members = shard_tables(spark, folder)
    labels = L.classes(train, test)
    models = L.logistic_models(members, train, labels, "fit", one_pass=True)
    return L.logistic_scores(test.select("label", "features"), models, labels, SAMPLES).select("sample", tidy(F.col("log_likelihood")).alias("value"))


DOC_SQL = """dq AS (SELECT d.source, l.quality, CASE WHEN d.n_chars >= 400 THEN 1 ELSE 0 END AS long, count(*) AS c FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2, 3),
src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS player, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM dq) s)"""


@query("document_source_value", q.with_(DOC_SQL, "pl AS (SELECT 0 AS game_id, CAST(player AS INTEGER) AS player, CAST(n AS INTEGER) AS n, source FROM src)", q.ordered(SAMPLES, "docs")) + """,
cu AS (SELECT r.sample, r.pos, r.player, r.source, dq.long, sum(c) FILTER (WHERE quality = 1) AS g, sum(c) AS t FROM rk r JOIN dq USING (source) GROUP BY 1, 2, 3, 4, 5),
al AS (SELECT long, sum(c) FILTER (WHERE quality = 1) AS ag, sum(c) AS allt FROM dq GROUP BY 1),
ps AS (SELECT DISTINCT sample, pos, player, source FROM rk),
rw AS (SELECT ps.sample, ps.pos, ps.source, al.long, sum(coalesce(g, 0)) OVER w AS sg, sum(coalesce(t, 0)) OVER w AS st, coalesce(ag, 0) AS ag, allt
  FROM ps CROSS JOIN al LEFT JOIN cu ON cu.sample = ps.sample AND cu.pos = ps.pos AND cu.long = al.long WINDOW w AS (PARTITION BY ps.sample, al.long ORDER BY ps.pos)),
ac AS (SELECT sample, pos, source, sum(CASE WHEN st = 0 THEN 0 WHEN 2*sg >= st THEN ag ELSE allt - ag END)/CAST(sum(allt) AS DOUBLE) AS v FROM rw GROUP BY 1, 2, 3),
mg AS (SELECT sample, source, v - coalesce(lag(v) OVER (PARTITION BY sample ORDER BY pos), 0) AS m FROM ac)
SELECT source, """ + q.tidy("avg(m)") + " AS share FROM mg GROUP BY 1")
def document_source_value(spark, folder):
    """Value of every document source for predicting quality from length, over random orders of sources.

    A coalition predicts the majority quality of its own documents per length class; the value is the
    accuracy on all labelled documents, 0 where it has none. Counts per (source, class) are enough.
    """
    from pyspark.sql import Window
    docs = S.table(spark, folder, "documents").select("doc_id", "source", (F.col("n_chars") >= 400).cast("int").alias("long"))
    counts = docs.join(S.table(spark, folder, "labels").select("doc_id", "quality"), "doc_id").groupBy("source").agg(*[
        F.sum(F.when((F.col("long") == k) & cond, 1).otherwise(0)).alias(name)
        for k in (0, 1) for cond, name in [(F.col("quality") == 1, f"good{k}"), (F.lit(True), f"all{k}")]])
    names = counts.select("source").distinct()
    place = Window.orderBy("source")
    # Sources are few (a dictionary column): one row each by now.
    players = counts.join(names, "source").select("*", (F.row_number().over(place) - 1).alias("player"), F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias("n"),
                                                   *[F.sum(c).over(Window.partitionBy()).alias(f"t_{c}") for c in ("good0", "all0", "good1", "all1")],
                                                   F.lit(0).cast("bigint").alias("game_id"))
    paths = D.random_order(Split(players), SAMPLES, "docs").rows()
    w = Window.partitionBy("game_id", "block", "sample").orderBy("pos")

    def right(k):
        good, seen = F.sum(f"good{k}").over(w), F.sum(f"all{k}").over(w)
        return F.when(seen == 0, 0).when(2 * good >= seen, F.col(f"t_good{k}")).otherwise(F.col(f"t_all{k}") - F.col(f"t_good{k}"))

    valued = paths.select("game_id", "block", "sample", "pos", "source", ((right(0) + right(1)) / (F.col("t_all0") + F.col("t_all1"))).alias("v"))
    marginal = valued.withColumn("m", F.col("v") - F.coalesce(F.lag("v").over(w), F.lit(0.0)))
    return marginal.groupBy("source").agg(tidy(F.avg("m")).alias("share"))
