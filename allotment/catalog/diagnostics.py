"""Design diagnostics on the sampled coalitions of customers' games."""

from __future__ import annotations

from pyspark.sql import functions as F

from allotment.catalog import sql as q
from allotment.catalog.designs import BASES_SQL, balanced_report, inner_games
from allotment.catalog.plans import GAMES_SQL, MIN_ONE_SQL
from allotment.catalog.registry import query
from allotment.functions.hashing import tidy
from allotment.functions.laws import INNER
from allotment.operators import balanced as G
from allotment.operators import designs as D
from allotment.operators import geometry as Y
from allotment.plans import budget as B
from allotment.sources import tables as S

T = 24


def design(spark, folder, samples=T):
    return D.iid_design(S.at_least(S.customer_orders(spark, folder), 4), samples, "geo", INNER).rows()


def base_sql(samples=T):
    return q.with_(q.game("max", 4), q.ordered(samples, "geo"), q.sizes(samples, "geo", "inner"), """ev AS (SELECT rk.game_id, rk.sample, rk.player, rk.n, sz.size, pos <= size AS inside FROM rk JOIN sz USING (game_id, sample))""")


def tidied(df, keys, places=6):
    return df.select(*[tidy(F.col(c), places).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


CNT = """cn AS (SELECT game_id, size, player, first(n) AS n, count(*) AS rws, count(*) FILTER (WHERE inside) AS h FROM ev GROUP BY 1, 2, 3)"""
MEAN = """sm AS (SELECT game_id, size, first(n) AS n, first(rws) AS rws, sum(n/CAST(size*(n-size) AS DOUBLE)*CASE WHEN h*n = size*rws THEN 0 ELSE (h/CAST(rws AS DOUBLE) - size/CAST(n AS DOUBLE)) END
  *CASE WHEN h*n = size*rws THEN 0 ELSE (h/CAST(rws AS DOUBLE) - size/CAST(n AS DOUBLE)) END) AS fs FROM cn GROUP BY 1, 2)"""
FRAME = """ds AS (SELECT *, sqrt(n/CAST(size*(n-size) AS DOUBLE))*(CAST(inside AS INTEGER) - size/CAST(n AS DOUBLE)) AS u FROM ev),
zz AS (SELECT DISTINCT n, z FROM law),
fr AS (SELECT a.game_id, a.n, a.player AS i, b.player AS j, first(z)*avg(sqrt(CAST(a.size*(a.n-a.size) AS DOUBLE))*a.u*b.u) AS op,
  (CASE WHEN a.player = b.player THEN 1 ELSE 0 END - 1.0/a.n)*(a.n-3)/(a.n-1) AS tg
  FROM ds a JOIN ds b ON a.game_id = b.game_id AND a.sample = b.sample JOIN zz ON zz.n = a.n GROUP BY 1, 2, 3, 4)"""
SLICE = """ds AS (SELECT *, sqrt(n/CAST(size*(n-size) AS DOUBLE))*(CAST(inside AS INTEGER) - size/CAST(n AS DOUBLE)) AS u FROM ev),
sf AS (SELECT a.game_id, a.n, a.size, a.player AS i, b.player AS j, avg(a.u*b.u) - (CASE WHEN a.player = b.player THEN 1 ELSE 0 END - 1.0/a.n)/(a.n-1) AS gap
  FROM ds a JOIN ds b ON a.game_id = b.game_id AND a.sample = b.sample GROUP BY 1, 2, 3, 4, 5),
s2 AS (SELECT game_id, size, sum(gap*gap) AS ss FROM sf GROUP BY 1, 2)"""


@query("design_directions", base_sql(4) + f"SELECT game_id, sample, player, {q.tidy('sqrt(n/CAST(size*(n-size) AS DOUBLE))*(CAST(inside AS INTEGER) - size/CAST(n AS DOUBLE))', 6)} AS u FROM ev")
def design_directions(spark, folder):
    return tidied(Y.directions(design(spark, folder, 4)), [])


@query("frame_targets", q.with_(q.game("max", 4), "tg AS (SELECT game_id, n, player AS i, CAST(j AS INTEGER) AS j, (CASE WHEN player = j THEN 1 ELSE 0 END - 1.0/n) AS p FROM pl, unnest(range(0, n)) r(j))")
       + f"SELECT game_id, i, j, {q.tidy('p', 6)} AS projector, {q.tidy('p*(n-3)/(n-1)', 6)} AS inner_target, {q.tidy('p/(n-1)', 6)} AS slice_target FROM tg")
def frame_targets(spark, folder):
    return tidied(Y.targets(S.at_least(S.customer_orders(spark, folder), 4).rows()), [])


@query("inner_frame_operator", base_sql() + "," + FRAME + f" SELECT game_id, i, j, {q.tidy('op', 6)} AS operator FROM fr")
def inner_frame_operator(spark, folder):
    return tidied(Y.inner_frame(design(spark, folder)).select("game_id", "i", "j", "operator"), [])


@query("frame_discrepancy", base_sql() + "," + FRAME + f" SELECT game_id, {q.tidy('sqrt(sum((op-tg)*(op-tg)))', 6)} AS frobenius, {q.tidy('sum(CASE WHEN i = j THEN op - tg ELSE 0 END)', 6)} AS trace FROM fr GROUP BY 1")
def frame_discrepancy(spark, folder):
    return tidied(Y.frame_discrepancy(Y.inner_frame(design(spark, folder))), [])


@query("mean_direction", base_sql() + "," + CNT + "," + MEAN + """,
ov AS (SELECT game_id, sqrt(sum(p*p/(t*t))) AS md FROM (SELECT game_id, player, sum(sqrt(n/CAST(size*(n-size) AS DOUBLE))*(h - rws*size/CAST(n AS DOUBLE))) AS p, sum(rws) AS t FROM cn GROUP BY 1, 2) x GROUP BY 1)
SELECT sm.game_id, """ + q.tidy("first(md)", 6) + " AS mean_direction, " + q.tidy("sqrt(avg(fs))", 6) + " AS slice_rms, " + q.tidy("sqrt(max(fs))", 6) + " AS slice_worst FROM sm JOIN ov USING (game_id) GROUP BY 1")
def mean_direction(spark, folder):
    return tidied(Y.mean_direction(Y.strata_counts(design(spark, folder))), [])


@query("spectral_discrepancy")
def spectral_discrepancy(spark, folder):
    return tidied(Y.spectral_discrepancy(Y.inner_frame(design(spark, folder))), [])


@query("slice_moments", base_sql() + "," + CNT + "," + MEAN + "," + SLICE + f" SELECT game_id, CAST(size AS INTEGER) AS size, rws AS rows, {q.tidy('fs', 6)} AS first_squared, {q.tidy('ss', 6)} AS second_squared FROM sm JOIN s2 USING (game_id, size)")
def slice_moments(spark, folder):
    return tidied(Y.slice_moments(design(spark, folder)).drop("n"), [])


@query("moment_summary", base_sql() + "," + CNT + "," + MEAN + "," + SLICE + ", al AS (SELECT * FROM sm JOIN s2 USING (game_id, size)) SELECT game_id, CAST(first(n) - 3 AS INTEGER) AS expected_sizes, count(*) AS observed_sizes, " + ", ".join(
    f"{q.tidy(e, 6)} AS {a}" for a, e in [("first_rms", "sqrt(avg(fs))"), ("second_rms", "sqrt(avg(ss))"), ("first_worst", "sqrt(max(fs))"), ("second_worst", "sqrt(max(ss))"),
                                          ("first_weighted", "sqrt(sum(rws*fs)/sum(rws))"), ("second_weighted", "sqrt(sum(rws*ss)/sum(rws))")]) + " FROM al GROUP BY 1")
def moment_summary(spark, folder):
    return tidied(Y.moment_summary(Y.slice_moments(design(spark, folder))), [])


@query("stratified_frame_summary", base_sql() + "," + SLICE + """, ag AS (SELECT game_id, sqrt(sum(g*g)) AS a FROM (SELECT game_id, i, j, sum(gap) AS g FROM sf GROUP BY 1, 2, 3) x GROUP BY 1)
SELECT game_id, """ + q.tidy("sqrt(avg(ss))", 6) + " AS slice_rms, " + q.tidy("sqrt(sum(ss))", 6) + " AS root_sum_squares, " + q.tidy("sqrt(max(ss))", 6) + " AS slice_worst, " + q.tidy("first(a)", 6) + " AS aggregate FROM s2 JOIN ag USING (game_id) GROUP BY 1")
def stratified_frame_summary(spark, folder):
    return tidied(Y.stratified_summary(Y.slice_frames(design(spark, folder))), [])


@query("orbit_signatures", q.with_(GAMES_SQL, MIN_ONE_SQL, BASES_SQL, "bm AS (SELECT * FROM bb WHERE pos <= size)", "nk AS (SELECT a.game_id, a.size, a.orbit, ((b.p - a.p) % a.n + a.n) % a.n AS k, count(*) AS c FROM bm a JOIN bm b ON a.game_id = b.game_id AND a.size = b.size AND a.orbit = b.orbit GROUP BY 1, 2, 3, 4)",
    "hd AS (SELECT DISTINCT game_id, n, size, orbit, k FROM bm, unnest(range(0, n)) r(k))") + f"SELECT game_id, size, CAST(orbit AS BIGINT) AS orbit, CAST(k AS INTEGER) AS k, {q.tidy('(coalesce(c, 0) - size*size/CAST(n AS DOUBLE))/(size*(n-size))', 6)} AS signature FROM hd LEFT JOIN nk USING (game_id, size, orbit, k)")
def orbit_signatures(spark, folder):
    g = inner_games(spark, folder)
    out = Y.orbit_signature(D.random_bases(g, B.minimum_one_counts(g, F.col("n") * 2, INNER), "rand"))
    return tidied(out.select("game_id", "size", "orbit", "k", "signature"), [])


COVER = """cz AS (SELECT game_id, size, first(n) AS n, min(h) AS lo, max(h) AS hi, min(rws-h) AS olo, count(*) FILTER (WHERE h = 0) AS ni, count(*) FILTER (WHERE rws = h) AS no FROM cn GROUP BY 1, 2),
cv AS (SELECT game_id, first(n) AS n, count(*) AS observed_sizes, count(*) FILTER (WHERE lo = hi) AS balanced_sizes, CASE WHEN count(*) = first(n)-3 THEN min(lo) ELSE 0 END AS least_in,
  CASE WHEN count(*) = first(n)-3 THEN min(olo) ELSE 0 END AS least_out, CAST(sum(ni) + (first(n)-3-count(*))*first(n) AS BIGINT) AS missing_in, CAST(sum(no) + (first(n)-3-count(*))*first(n) AS BIGINT) AS missing_out FROM cz GROUP BY 1)"""


@query("design_coverage", base_sql() + "," + CNT + "," + COVER + " SELECT * FROM cv")
def design_coverage(spark, folder):
    return Y.coverage(Y.strata_counts(design(spark, folder)))


@query("missing_stratum_fraction", base_sql() + "," + CNT + "," + COVER + f" SELECT game_id, {q.tidy('(missing_in + missing_out)/CAST(2*n*(n-3) AS DOUBLE)', 6)} AS missing_fraction FROM cv")
def missing_stratum_fraction(spark, folder):
    return tidied(Y.missing_fraction(Y.coverage(Y.strata_counts(design(spark, folder)))), [])


@query("design_imbalance", base_sql() + "," + CNT + """, im AS (SELECT game_id, size, max(abs(h - g)) AS w, sum(abs(h - g)) AS t, count(*) AS c, max(abs(h - g))/greatest(first(g), 1) AS r, stddev_pop(h)/greatest(first(g), 1) AS cv
  FROM (SELECT *, rws*size/CAST(n AS DOUBLE) AS g FROM cn) x GROUP BY 1, 2) SELECT game_id, """ + ", ".join(f"{q.tidy(e, 6)} AS {a}" for a, e in [
    ("worst_deviation", "max(w)"), ("mean_deviation", "sum(t)/sum(c)"), ("worst_relative", "max(r)"), ("mean_cv", "avg(cv)"), ("worst_cv", "max(cv)")]) + " FROM im GROUP BY 1")
def design_imbalance(spark, folder):
    return tidied(Y.imbalance(Y.strata_counts(design(spark, folder))), [])


@query("size_histogram", base_sql() + "SELECT game_id, CAST(size AS INTEGER) AS size, count(*) AS coalitions FROM ev WHERE player = 0 GROUP BY 1, 2")
def size_histogram(spark, folder):
    return Y.size_histogram(design(spark, folder))


@query("design_fingerprint", base_sql() + """, cm AS (SELECT game_id, sample, md5(concat_ws('|', sample, string_agg(CAST(player AS VARCHAR), ',' ORDER BY player))) AS h FROM ev WHERE inside GROUP BY 1, 2),
pt AS (SELECT game_id, sample//16 AS part, md5(string_agg(h, '' ORDER BY sample)) AS h FROM cm GROUP BY 1, 2)
SELECT game_id, md5(string_agg(h, '' ORDER BY part)) AS fingerprint FROM pt GROUP BY 1""")
def design_fingerprint(spark, folder):
    return Y.fingerprint(D.coalition_arrays(design(spark, folder)), bucket=16)


@query("greedy_design_discrepancy")
def greedy_design_discrepancy(spark, folder):
    """Frame discrepancy of the balanced per-size design."""
    players = S.at_least(S.customer_orders(spark, folder), 4).rows()
    design_ = G.per_size_design(inner_games(spark, folder), F.col("n") * 3, "sys")
    rows = G.sampled_rows(design_, players).withColumn("block", F.when(F.col("n") <= 512, F.lit(D.WHOLE)).otherwise(F.lit(0)).cast("bigint"))
    return tidied(Y.frame_discrepancy(Y.inner_frame(rows)), [])
