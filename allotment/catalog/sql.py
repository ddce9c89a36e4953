"""Common table expressions shared by the SQL twins."""

from __future__ import annotations


def key(*parts: str) -> str:
    return "CAST('0x'||substr(md5(concat_ws('|'," + ",".join(parts) + ")),1,15) AS BIGINT)"


def unit(*parts: str) -> str:
    return "(CAST(CAST('0x'||substr(md5(concat_ws('|'," + ",".join(parts) + ")),1,8) AS BIGINT) AS DOUBLE)/4294967296.0)"


def tidy(expr: str, places: int = 4) -> str:
    return f"(round(({expr}) + 3.7e-8, {places}) + 0.0)"


ORDERS = """pl0 AS (SELECT o_custkey AS game_id, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS player,
  CAST(count(*) OVER (PARTITION BY o_custkey) AS INTEGER) AS n,
  CAST(floor(o_totalprice/1000) AS BIGINT) AS cost,
  CAST(sum(CAST(floor(o_totalprice/1000) AS BIGINT)) OVER (PARTITION BY o_custkey) AS BIGINT) AS total FROM orders),
pl1 AS (SELECT *, cost AS weight, total//2 + 1 AS quota FROM pl0)"""

LINES = """ln AS (SELECT l_orderkey AS game_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS INTEGER) AS player,
  CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n,
  CAST(round(l_extendedprice*100) AS BIGINT) AS cost FROM lineitem)"""

# Boundary values by game kind: empty, full, single and leave-one-out, per player.
MAX_BOUNDARY = """pl AS (SELECT b.*, CAST(0 AS DOUBLE) AS empty_value, CAST(top AS DOUBLE) AS full_value,
  CAST(cost AS DOUBLE) AS single_value,
  CAST(CASE WHEN cost = top AND tops = 1 THEN coalesce(second, 0) ELSE top END AS DOUBLE) AS without_value
  FROM pl1 b JOIN (SELECT a.game_id, max(a.cost) AS top, count(*) FILTER (WHERE a.cost = m.top) AS tops,
    max(a.cost) FILTER (WHERE a.cost < m.top) AS second
    FROM pl1 a JOIN (SELECT game_id, max(cost) AS top FROM pl1 GROUP BY 1) m USING (game_id) GROUP BY 1) t USING (game_id)
  WHERE n >= {least})"""

VOTE_BOUNDARY = """pl AS (SELECT *, CAST(0 AS DOUBLE) AS empty_value, CAST(1 AS DOUBLE) AS full_value,
  CAST(CASE WHEN weight >= quota THEN 1 ELSE 0 END AS DOUBLE) AS single_value,
  CAST(CASE WHEN total - weight >= quota THEN 1 ELSE 0 END AS DOUBLE) AS without_value
  FROM pl1 WHERE n >= {least})"""

WEIGHTS = {"inner": ("1.0/sqrt(CAST(s*(n-s) AS DOUBLE))", 2, 2), "kernel": ("1.0/CAST(s*(n-s) AS DOUBLE)", 1, 1),
           "uniform": ("1.0", 1, 0)}


def law(name: str, source: str = "pl") -> str:
    w, first, last = WEIGHTS[name]
    return f"""law AS (SELECT n, s, z, w, CASE WHEN s = {first} THEN -1 ELSE cum - w END AS lo,
  CASE WHEN s = n - {last} THEN 1e300 ELSE cum END AS hi FROM (
  SELECT n, s, w, sum(w) OVER (PARTITION BY n ORDER BY s) AS cum, sum(w) OVER (PARTITION BY n) AS z FROM (
  SELECT n, CAST(s AS BIGINT) AS s, {w} AS w FROM (SELECT DISTINCT n FROM {source}) d, unnest(range({first}, n - {last} + 1)) r(s)) a) b)"""


def ordered(samples: int, seed: str, source: str = "pl") -> str:
    return f"""rk AS (SELECT p.*, CAST(t.sample AS BIGINT) AS sample,
  row_number() OVER (PARTITION BY p.game_id, t.sample ORDER BY {key(f"'{seed}'", 'p.game_id', 't.sample', 'p.player')}, p.player) AS pos
  FROM {source} p, range({samples}) t(sample))"""


def sizes(samples: int, seed: str, law_name: str, source: str = "pl") -> str:
    u = unit(f"'{seed}'", "'size'", "h.game_id", "t.sample")
    if law_name == "uniform":
        return f"""sz AS (SELECT h.game_id, CAST(t.sample AS BIGINT) AS sample, CAST(floor({u}*h.n) + 1 AS BIGINT) AS size
  FROM {source} h, range({samples}) t(sample) WHERE h.player = 0)"""
    return law(law_name, source) + f""",
hd AS (SELECT h.game_id, h.n, CAST(t.sample AS BIGINT) AS sample, {u} AS u FROM {source} h, range({samples}) t(sample) WHERE h.player = 0),
sz AS (SELECT hd.game_id, hd.sample, l.s AS size FROM hd JOIN law l ON l.n = hd.n AND hd.u*l.z >= l.lo AND hd.u*l.z < l.hi)"""


MAX_VALUE = ("CAST(coalesce(max(cost) FILTER (WHERE pos <= size) OVER g, 0) AS DOUBLE)",
             "CAST(coalesce(max(cost) FILTER (WHERE pos > size) OVER g, 0) AS DOUBLE)")
VOTE_VALUE = ("CAST(CASE WHEN coalesce(sum(weight) FILTER (WHERE pos <= size) OVER g, 0) >= quota THEN 1 ELSE 0 END AS DOUBLE)",
              "CAST(CASE WHEN coalesce(sum(weight) FILTER (WHERE pos > size) OVER g, 0) >= quota THEN 1 ELSE 0 END AS DOUBLE)")


def evaluated(value=MAX_VALUE) -> str:
    return f"""ev AS (SELECT rk.*, sz.size, pos <= sz.size AS inside, {value[0]} AS value, {value[1]} AS rest
  FROM rk JOIN sz USING (game_id, sample) WINDOW g AS (PARTITION BY rk.game_id, rk.sample))"""


def path_values(value: str = "max") -> str:
    state = {"max": "CAST(coalesce(max(cost) OVER ({f}), 0) AS DOUBLE)",
             "vote": "CAST(CASE WHEN coalesce(sum(weight) OVER ({f}), 0) >= quota THEN 1 ELSE 0 END AS DOUBLE)"}[value]
    order = "PARTITION BY game_id, sample ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND "
    return f"""pv AS (SELECT *, {state.format(f=order + 'CURRENT ROW')} AS value,
  {state.format(f=order + '1 PRECEDING')} AS before FROM rk),
pm AS (SELECT *, value - before AS marginal FROM pv)"""


BOUNDARY_SHARE = """bs AS (SELECT *, (full_value - empty_value)/n + single_value/n
  - (sum(single_value) OVER g - single_value)/(n*greatest(n-1, 1))
  + (sum(without_value) OVER g - without_value)/(n*greatest(n-1, 1)) - without_value/n AS boundary_share
  FROM pl WINDOW g AS (PARTITION BY game_id))"""


def game(kind: str = "max", least: int = 1) -> str:
    return ORDERS + ",\n" + (MAX_BOUNDARY if kind == "max" else VOTE_BOUNDARY).format(least=least)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
