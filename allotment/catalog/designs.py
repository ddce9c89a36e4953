"""Sampling designs over the games of customers: which coalitions or orders are drawn."""

from __future__ import annotations

from pyspark.sql import functions as F

from allotment.catalog import sql as q
from allotment.catalog.plans import GAMES_SQL, MIN_ONE_SQL, PP_SQL, games
from allotment.catalog.registry import query
from allotment.catalog.sampling import max_game
from allotment.functions.fields import field_tables
from allotment.functions.hashing import tidy
from allotment.functions.laws import INNER, KERNEL
from allotment.operators import balanced as G
from allotment.operators import designs as D
from allotment.plans import budget as B
from allotment.sources import tables as S

T = 6


def listed(col="members"):
    return F.concat_ws(",", F.transform(col, lambda m: m.cast("string")))


def listed_sql(where="inside", name="members"):
    return f"string_agg(CAST(player AS VARCHAR), ',' ORDER BY player) FILTER (WHERE {where}) AS {name}"


def law_sql(name):
    w, first, last = q.WEIGHTS[name]
    return q.with_(GAMES_SQL, q.law(name, "gm")) + f"""SELECT n, CAST(s AS INTEGER) AS size, {q.tidy('z', 6)} AS normaliser, {q.tidy('w/z', 6)} AS share,
  {q.tidy('sum(w/z) OVER (PARTITION BY n ORDER BY s)', 6)} AS high FROM law WHERE n >= {first + last}"""


def law_table(law):
    def run(spark, folder):
        t = D.size_law_table(games(spark, folder), law)
        return t.select("n", "size", *[tidy(F.col(c), 6).alias(c) for c in ("normaliser", "share", "high")])
    return run


query("inner_size_law", law_sql("inner"))(law_table(INNER))
query("kernel_size_law", law_sql("kernel"))(law_table(KERNEL))

SYSTEMATIC_SQL = """hd AS (SELECT game_id, n, 3*n AS t, st AS step, {u} AS start FROM gm, unnest(range(0, 3*n)) r(st) WHERE n >= 4),
pt AS (SELECT *, (start + step/CAST(t AS DOUBLE)) - floor(start + step/CAST(t AS DOUBLE)) AS u FROM hd),
sc AS (SELECT pt.game_id, pt.n, t, step, l.s AS size, row_number() OVER (PARTITION BY pt.game_id ORDER BY {k}, step) - 1 AS sample
  FROM pt JOIN law l ON l.n = pt.n AND pt.u*l.z >= l.lo AND pt.u*l.z < l.hi)""".format(
    u=q.unit("'sys'", "'start'", "game_id"), k=q.key("'sys'", "'shuffle'", "pt.game_id", "step"))


@query("systematic_sizes", q.with_(GAMES_SQL, q.law("inner", "gm"), SYSTEMATIC_SQL) + "SELECT game_id, CAST(sample AS BIGINT) AS sample, CAST(size AS INTEGER) AS size FROM sc")
def systematic_sizes(spark, folder):
    t = games(spark, folder).where("n >= 4")
    return D.systematic_schedule(t, F.col("n") * 3, "sys", INNER).select("game_id", F.col("sample").cast("bigint").alias("sample"), "size")


def design_report(split):
    return D.coalition_arrays(split.rows()).select("game_id", "sample", "size", listed().alias("members"))


COALITIONS = f"SELECT game_id, sample, CAST(size AS INTEGER) AS size, {listed_sql('pos <= size')} FROM rk JOIN sz USING (game_id, sample) GROUP BY 1, 2, 3"


@query("fixed_size_coalitions", q.with_(q.game("max", 2), q.ordered(T, "fix"), "sz AS (SELECT DISTINCT game_id, sample, (n+1)//2 AS size FROM rk)") + COALITIONS)
def fixed_size_coalitions(spark, folder):
    players = S.at_least(S.customer_orders(spark, folder), 2)
    sized = D.with_sizes(D.random_order(players, T, "fix"), lambda: F.floor((F.col("n") + 1) / 2).cast("int"))
    return design_report(D.mark_inside(sized))


@query("iid_inner_design", q.with_(q.game("max", 4), q.ordered(T, "iid"), q.sizes(T, "iid", "inner")) + COALITIONS)
def iid_inner_design(spark, folder):
    return design_report(D.iid_design(S.at_least(S.customer_orders(spark, folder), 4), T, "iid", INNER))


@query("boundary_coalitions", q.with_(q.game("max")) + """SELECT game_id, 'single' AS kind, player, 1 AS size FROM pl UNION ALL
SELECT game_id, 'loo', player, n - 1 FROM pl UNION ALL SELECT game_id, 'empty', NULL, 0 FROM pl WHERE player = 0
UNION ALL SELECT game_id, 'full', NULL, n FROM pl WHERE player = 0""")
def boundary_coalitions(spark, folder):
    return D.boundary_coalitions(S.customer_orders(spark, folder).rows())


@query("complement_pairs", q.with_(q.game("max"), q.ordered(T, "pair"), q.sizes(T, "pair", "uniform")) + f"""SELECT game_id, sample, CAST(size AS INTEGER) AS size,
  {listed_sql('pos <= size')}, coalesce(string_agg(CAST(player AS VARCHAR), ',' ORDER BY player) FILTER (WHERE pos > size), '') AS rest
  FROM rk JOIN sz USING (game_id, sample) GROUP BY 1, 2, 3""")
def complement_pairs(spark, folder):
    rows = D.complement_design(S.customer_orders(spark, folder), T, "pair").rows()
    side = lambda keep: F.sort_array(F.collect_list(F.when(keep, F.col("player"))))
    pairs = rows.groupBy("game_id", "sample", "size").agg(side(F.col("inside")).alias("members"), side(~F.col("inside")).alias("rest"))
    return pairs.select("game_id", "sample", "size", listed().alias("members"), listed("rest").alias("rest"))


@query("random_permutations", q.with_(q.game("max"), q.ordered(T, "ord")) + "SELECT game_id, sample, CAST(pos AS INTEGER) AS pos, player FROM rk")
def random_permutations(spark, folder):
    return D.random_order(S.customer_orders(spark, folder), T, "ord").rows().select("game_id", "sample", "pos", "player")


@query("antithetic_permutations", q.with_(q.game("max"), q.ordered(3, "anti")) + """SELECT game_id, sample AS pair, CAST(d AS INTEGER) AS direction,
  CAST(CASE WHEN d = 1 THEN n + 1 - pos ELSE pos END AS INTEGER) AS pos, player FROM rk, range(2) r(d)""")
def antithetic_permutations(spark, folder):
    rows = D.antithetic(S.customer_orders(spark, folder), 3, "anti").rows()
    return rows.select("game_id", "pair", "direction", "pos", "player")


@query("prefix_coalitions", q.with_(q.game("max"), q.ordered(2, "pre")) + """SELECT a.game_id, a.sample, CAST(a.pos AS INTEGER) AS size,
  string_agg(CAST(b.player AS VARCHAR), ',' ORDER BY b.pos) AS members FROM rk a JOIN rk b ON a.game_id = b.game_id AND a.sample = b.sample AND b.pos <= a.pos
  WHERE a.pos < a.n GROUP BY 1, 2, 3""")
def prefix_coalitions(spark, folder):
    from pyspark.sql import Window
    w = Window.partitionBy("game_id", "block", "sample").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = D.random_order(S.customer_orders(spark, folder), 2, "pre").rows()
    rows = rows.select("game_id", "sample", "n", F.col("pos").alias("size"), F.collect_list("player").over(w).alias("members"))
    return rows.where("size < n").select("game_id", "sample", "size", listed().alias("members"))


def _perm(name, tag, source="gm", span="n", fixed=True, block="b"):
    k = q.key(f"'{tag[0]}'", f"'{tag[1]}'", "game_id", block, "p")
    first = f"CASE WHEN p = 0 THEN -1 ELSE {k} END" if fixed else k
    return f"""{name} AS (SELECT game_id, n, {block}, p, row_number() OVER (PARTITION BY game_id, {block} ORDER BY {first}, p) - 1 AS i
  FROM {source}, range(2) rb({block}), unnest(range(0, {span})) r(p))"""


LATIN_SQL = ",\n".join([_perm("ba", ("ls", "base")), _perm("co", ("ls", "cols"), fixed=False), _perm("ro", ("ls", "rows"))]) + """,
ls AS (SELECT ro.game_id, ro.n, ro.b AS design_block, ro.b*ro.n + ro.i AS sample, co.i + 1 AS pos, ba.p AS player
  FROM ro JOIN co USING (game_id, b) JOIN ba ON ba.game_id = ro.game_id AND ba.b = ro.b AND ba.i = (ro.p + co.p) % ro.n)"""


@query("latin_square_permutations", q.with_(GAMES_SQL, LATIN_SQL) + """SELECT game_id, CAST(design_block AS INTEGER) AS design_block, CAST(sample AS BIGINT) AS sample,
  CAST(pos AS INTEGER) AS pos, CAST(player AS INTEGER) AS player FROM ls""")
def latin_square_permutations(spark, folder):
    return D.latin_square(games(spark, folder), 2, "ls").select("game_id", "design_block", "sample", "pos", "player")


def field_values():
    """Sums and products of the proper prime powers as rows (q, a, b, sum, product)."""
    out = []
    for size in (4, 8, 9, 16, 25, 27, 32):
        sums, products = field_tables(size)
        out += [f"({size},{a},{b},{sums[a][b]},{products[a][b]})" for a in range(size) for b in range(size)]
    return "ft AS (SELECT * FROM (VALUES " + ",".join(out) + ") v(q, a, b, s, m))"


def coa_sql(blocks=1):
    return field_values() + ",\n" + PP_SQL + ",\n" + coa_rows_sql(blocks)


def coa_rows_sql(blocks):
    return """gq AS (SELECT gm.game_id, gm.n, pp.q, b FROM gm JOIN pp USING (n), range({blocks}) t(b)),
cp AS (SELECT game_id, n, q, b, p, row_number() OVER (PARTITION BY game_id, b ORDER BY CASE WHEN p = 0 THEN -1 ELSE {k} END, p) - 1 AS i
  FROM gq, unnest(range(0, q)) r(p)),
cr AS (SELECT cp.*, rw, rw//(q-1) AS sh, rw%(q-1) + 1 AS sc FROM cp, unnest(range(0, q*(q-1))) r(rw)),
cs AS (SELECT cr.*, CASE WHEN f1.q IS NULL THEN (sh + sc*p) % cr.q ELSE f2.s END AS symbol FROM cr
  LEFT JOIN ft f1 ON f1.q = cr.q AND f1.a = sc AND f1.b = cr.p LEFT JOIN ft f2 ON f2.q = cr.q AND f2.a = sh AND f2.b = f1.m),
coa AS (SELECT game_id, n, b AS design_block, b*q*(q-1) + rw AS sample, symbol AS player,
  row_number() OVER (PARTITION BY game_id, b, rw ORDER BY i) AS pos FROM cs WHERE symbol < n)""".format(
        blocks=blocks, k=q.key("'coa'", "'coa'", "game_id", "b", "p"))


# The least prime power at or above every n, and the sums and products of the fields that are no prime: by rule, for any n.
# wk walks the powers of x modulo x^k + m's digits for every m; the least m that meets all q - 1 elements is the modulus.
ANY_FIELD_SQL = """nn AS (SELECT DISTINCT CAST(n AS BIGINT) AS n FROM gm),
cc AS (SELECT DISTINCT c FROM nn, unnest(range(greatest(n, 2), 2*n + 2)) r(c)),
dv AS (SELECT c, min(d) AS p FROM cc, unnest(range(2, c + 1)) r(d) WHERE c % d = 0 GROUP BY 1),
pw AS (SELECT c, p, CAST(round(ln(c)/ln(p)) AS INTEGER) AS k FROM dv),
pr AS (SELECT c, p, k FROM pw WHERE list_product([CAST(p AS DOUBLE) for i in range(k)]) = c),
pp AS (SELECT n, (SELECT min(c) FROM pr WHERE c >= nn.n) AS q FROM nn),
wk AS (WITH RECURSIVE w(q, p, k, m, e, v) AS (SELECT c, p, k, m, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM pr, unnest(range(0, c)) r(m) WHERE k > 1 AND c IN (SELECT q FROM pp)
  UNION ALL SELECT q, p, k, m, e + 1, nv FROM (SELECT *, CAST(list_sum([
    ((CASE WHEN i = 0 THEN 0 ELSE v // CAST(p^(i - 1) AS BIGINT) % p END - v // CAST(p^(k - 1) AS BIGINT) * (m // CAST(p^i AS BIGINT) % p)) % p + p) % p * CAST(p^i AS BIGINT) for i in range(k)]) AS BIGINT) AS nv FROM w) x
  WHERE e < q - 2 AND nv NOT IN (0, 1)) SELECT * FROM w),
md AS (SELECT q, min(m) AS m FROM (SELECT q, m FROM wk GROUP BY q, m HAVING count(DISTINCT v) = q - 1) x GROUP BY 1),
lg AS (SELECT q, p, k, e, v FROM wk JOIN md USING (q, m) UNION ALL SELECT c, p, k, NULL, 0 FROM pr WHERE c IN (SELECT q FROM md)),
ft AS (SELECT a.q, a.v AS a, b.v AS b, CAST(list_sum([(a.v // CAST(a.p^i AS BIGINT) + b.v // CAST(a.p^i AS BIGINT)) % a.p * CAST(a.p^i AS BIGINT) for i in range(a.k)]) AS BIGINT) AS s,
  coalesce(c.v, 0) AS m FROM lg a JOIN lg b USING (q) LEFT JOIN lg c ON c.q = a.q AND c.e = (a.e + b.e) % (a.q - 1))"""


@query("component_array_permutations", q.with_(GAMES_SQL, coa_sql()) + """SELECT game_id, CAST(pos AS INTEGER) AS pos, CAST(player AS INTEGER) AS player,
  count(*) AS permutations, CAST(sum(sample*sample) AS BIGINT) AS check_sum FROM coa GROUP BY 1, 2, 3""")
def component_array_permutations(spark, folder):
    """How often every player stands at every position, with a checksum of the permutations."""
    rows = D.component_array(games(spark, folder), 1, "coa")
    return rows.groupBy("game_id", "pos", "player").agg(
        F.count(F.lit(1)).alias("permutations"), F.sum(F.col("sample") * F.col("sample")).alias("check_sum"))


@query("field_tables", q.with_(GAMES_SQL, PP_SQL, field_values(), "qs AS (SELECT q, count(*) AS games FROM gm JOIN pp USING (n) GROUP BY 1)") + """
SELECT CAST(qs.q AS INTEGER) AS q, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(s AS INTEGER) AS sum, CAST(m AS INTEGER) AS product, CAST(games AS BIGINT) AS games FROM qs JOIN ft USING (q)
UNION ALL SELECT q, CAST(a AS INTEGER), CAST(b AS INTEGER), CAST((a+b)%q AS INTEGER), CAST(a*b%q AS INTEGER), CAST(games AS BIGINT) FROM qs, unnest(range(0, q)) r(a), unnest(range(0, q)) r2(b) WHERE q NOT IN (SELECT q FROM ft)""")
def field_tables_used(spark, folder):
    """The fields that the games need, with the number of games that use each."""
    used = games(spark, folder).groupBy(B.field_order(F.col("n")).alias("q")).agg(F.count(F.lit(1)).alias("games"))
    orders = [p for p in sorted({o for _, o in B.field_orders(64)})]
    rows = [(p, a, b, field_tables(p)[0][a][b], field_tables(p)[1][a][b]) for p in orders for a in range(p) for b in range(p)]
    tables = used.sparkSession.createDataFrame(rows, "q INT, a INT, b INT, sum INT, product INT")
    return tables.join(used, "q").select("q", "a", "b", "sum", "product", "games")


@query("orthogonal_permutations")
def orthogonal_permutations(spark, folder):
    orders = G.orthogonal_orders(games(spark, folder), F.lit(3), "orth")
    return orders.select("game_id", "pair", F.posexplode("players").alias("at", "player"))


POOL_SQL = """cd AS (SELECT game_id, n, (n+1)//2 AS size, c AS candidate, p AS player,
  row_number() OVER (PARTITION BY game_id, c ORDER BY {k}, p) AS pos FROM gm, range(8) rc(c), unnest(range(0, n)) r(p) WHERE n >= 2),
us AS (SELECT game_id, p AS player, row_number() OVER (PARTITION BY game_id ORDER BY {k2}, p) AS pos, (n+1)//2 AS size FROM gm, unnest(range(0, n)) r(p) WHERE n >= 2),
ul AS (SELECT game_id, string_agg(CAST(player AS VARCHAR), ',' ORDER BY player) AS members FROM us WHERE pos <= size GROUP BY 1),
cl AS (SELECT game_id, candidate, size, string_agg(CAST(player AS VARCHAR), ',' ORDER BY player) AS members FROM cd WHERE pos <= size GROUP BY 1, 2, 3)""".format(
    k=q.key("'pool'", "game_id", "c", "p"), k2=q.key("'used'", "'base'", "game_id", "(n+1)//2", "0", "p"))


@query("candidate_pool", q.with_(GAMES_SQL, POOL_SQL) + """SELECT cl.game_id, CAST(min(candidate) AS INTEGER) AS candidate, CAST(size AS INTEGER) AS size, members FROM cl
WHERE NOT EXISTS (SELECT 1 FROM ul WHERE ul.game_id = cl.game_id AND ul.members = cl.members) GROUP BY cl.game_id, size, members""")
def candidate_pool(spark, folder):
    g = games(spark, folder).where("n >= 2")
    half = F.floor((F.col("n") + 1) / 2)
    used = D.random_bases(g, g.withColumn("size", half.cast("int")).withColumn("count", F.lit(1).cast("bigint")), "used")
    return D.candidate_pool(g, half, 8, "pool", used).select("game_id", "candidate", "size", listed().alias("members"))


def inner_games(spark, folder):
    return games(spark, folder).where("n >= 4")


def balanced_report(df):
    return df.select("game_id", "design", "sample", "size", listed().alias("members"))


@query("greedy_per_size_design")
def greedy_per_size_design(spark, folder):
    return balanced_report(G.per_size_design(inner_games(spark, folder), F.col("n") * 3, "sys"))


@query("greedy_mean_only_design")
def greedy_mean_only_design(spark, folder):
    return balanced_report(G.per_size_design(inner_games(spark, folder), F.col("n") * 3, "sys", frame_weight=0.0, name="mean_only"))


@query("greedy_frame_only_design")
def greedy_frame_only_design(spark, folder):
    return balanced_report(G.per_size_design(inner_games(spark, folder), F.col("n") * 3, "sys", lambda0=0.0, name="frame_only"))


@query("mean_balance_normalised", q.with_(GAMES_SQL, q.law("inner", "gm"), SYSTEMATIC_SQL) + f"""SELECT game_id, {q.tidy('avg(size*(n-size))', 6)} AS mean_weight_squared,
  {q.tidy('(1 - 1.0/(n-1))*avg(size*(n-size))', 6)} AS factor, {q.tidy('0.0625*(1 - 1.0/(n-1))*avg(size*(n-size))', 6)} AS effective FROM sc GROUP BY game_id, n""")
def mean_balance_normalised(spark, folder):
    schedule = D.systematic_schedule(inner_games(spark, folder), F.col("n") * 3, "sys", INNER)
    out = G.mean_balance(schedule, 1 / 16, radial=True)
    return out.select("game_id", *[tidy(F.col(c), 6).alias(c) for c in ("mean_weight_squared", "factor", "effective")])


@query("coupled_frame_design")
def coupled_frame_design(spark, folder):
    return balanced_report(G.coupled_design(inner_games(spark, folder), F.col("n") * 3, "sys"))


@query("stratified_frame_design")
def stratified_frame_design(spark, folder):
    return balanced_report(G.stratified_design(inner_games(spark, folder), F.col("n") * 3, "strat"))


RELABEL_SQL = """lb AS (SELECT game_id, n, p, row_number() OVER (PARTITION BY game_id ORDER BY {k}, p) - 1 AS i FROM gm, unnest(range(0, n)) r(p))""".format(
    k=q.key("'rel'", "'relabel'", "game_id", "p"))


@query("relabelled_design", q.with_(q.game("max", 4), q.ordered(T, "iid"), q.sizes(T, "iid", "inner"), GAMES_SQL, RELABEL_SQL) + """
SELECT rk.game_id, sample, CAST(size AS INTEGER) AS size, string_agg(CAST(lb.p AS VARCHAR), ',' ORDER BY lb.p) AS members
FROM rk JOIN sz USING (game_id, sample) JOIN lb ON lb.game_id = rk.game_id AND lb.i = rk.player WHERE pos <= size GROUP BY 1, 2, 3""")
def relabelled_design(spark, folder):
    rows = D.iid_design(S.at_least(S.customer_orders(spark, folder), 4), T, "iid", INNER).rows()
    arrays = D.coalition_arrays(rows, ["n"])
    return D.relabel(arrays, "rel").select("game_id", "sample", "size", listed().alias("members"))


BASES_SQL = """bb AS (SELECT mo.game_id, mo.n, mo.size, o AS orbit, p, row_number() OVER (PARTITION BY mo.game_id, mo.size, o ORDER BY {k}, p) AS pos
  FROM mo, unnest(range(0, mo.count)) ro(o), unnest(range(0, mo.n)) r(p))""".format(k=q.key("'rand'", "'base'", "mo.game_id", "mo.size", "o", "p"))


@query("random_cyclic_orbits", q.with_(GAMES_SQL, MIN_ONE_SQL, BASES_SQL) + """SELECT game_id, size, CAST(orbit AS BIGINT) AS orbit, CAST(h AS INTEGER) AS shift,
  string_agg(CAST((p + h) % n AS VARCHAR), ',' ORDER BY (p + h) % n) AS members FROM bb, unnest(range(0, n)) r(h) WHERE pos <= size GROUP BY 1, 2, 3, 4""")
def random_cyclic_orbits(spark, folder):
    g = inner_games(spark, folder)
    orbits = D.cyclic_orbit(D.random_bases(g, B.minimum_one_counts(g, F.col("n") * 2, INNER), "rand"))
    return orbits.select("game_id", "size", "orbit", "shift", listed().alias("members"))


@query("orbit_frame_design")
def orbit_frame_design(spark, folder):
    bases = G.orbit_base_design(inner_games(spark, folder), F.col("n"), "orbit")
    return balanced_report(G.expand_orbits(bases, "orbit"))


@query("orbit_coupled_design")
def orbit_coupled_design(spark, folder):
    bases = G.coupled_orbit_bases(inner_games(spark, folder), F.lit(4), "corbit")
    return balanced_report(G.expand_orbits(bases, "corbit", per_size=False))


@query("paired_orbit_designs")
def paired_orbit_designs(spark, folder):
    bases = G.orbit_base_design(inner_games(spark, folder), F.col("n"), "orbit", arms=("orbit", "random_orbit"))
    return balanced_report(G.expand_orbits(bases, "orbit"))


@query("paired_scope_designs")
def paired_scope_designs(spark, folder):
    g = inner_games(spark, folder)
    both = G.coupled_design(g, F.col("n") * 3, "sys").unionByName(G.per_size_design(g, F.col("n") * 3, "sys"))
    return balanced_report(both)


SDIFF_SQL = """sp AS (SELECT game_id, n, s, p, row_number() OVER (PARTITION BY game_id, s ORDER BY {k}, p) - 1 AS i
  FROM gm, unnest(range(1, n//2 + 1)) rs(s), unnest(range(0, n)) r(p) WHERE n >= 2),
sb AS (SELECT sp.*, b FROM sp, unnest(range(0, (n + s - 1)//s)) r(b)),
sm AS (SELECT *, ((i - b*s) % n + n) % n < s AS inside FROM sb)""".format(k=q.key("'sd'", "'sdiff'", "game_id", "s", "p"))


@query("sdiff_partitions", q.with_(GAMES_SQL, SDIFF_SQL) + """SELECT game_id, CAST(s AS INTEGER) AS base_size, CAST(b AS INTEGER) AS part, CAST(c AS INTEGER) AS complement,
  string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS members FROM sm, range(2) r(c) WHERE inside = (c = 0) GROUP BY 1, 2, 3, 4""")
def sdiff_partitions(spark, folder):
    parts = D.partition_blocks(games(spark, folder), "sd")
    return parts.select("game_id", "base_size", "part", "complement", listed().alias("members"))


@query("sdiff_pair_fill")
def sdiff_pair_fill(spark, folder):
    parts = D.partition_blocks(games(spark, folder), "sd").where("complement = 0")
    fills = G.fill_pairs(parts.select("game_id", "n", F.col("base_size").alias("size"), "members"), "sd")
    return fills.select("game_id", "size", listed().alias("members"))


@query("multinomial_size_counts", q.with_(q.game("max", 2), q.sizes(T * 4, "multi", "kernel")) + "SELECT game_id, CAST(size AS INTEGER) AS size, count(*) AS count FROM sz GROUP BY 1, 2")
def multinomial_size_counts(spark, folder):
    from allotment.functions.hashing import uniform
    g = games(spark, folder).where("n >= 2").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(T * 4 - 1))))
    size = KERNEL.draw(uniform("multi", F.lit("size"), F.col("game_id"), F.col("sample")), F.col("n"))
    return g.groupBy("game_id", size.alias("size")).agg(F.count(F.lit(1)).alias("count"))
