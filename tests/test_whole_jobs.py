"""No game is left out: component arrays of any number of players, and pairs that are all told apart."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from allotment.catalog import ORACLES, QUERIES
from allotment.operators import designs as D
from allotment.plans import budget as B
from check import compare


def orders_folder(spark, tmp_path, **counts):
    """A folder with a table of orders: customer key -> number of orders."""
    rows = [(1000 * c + i, c, "O", float((i * 7919 + c * 104729) % 90000 + 1000), datetime.datetime(2024, 1, 1), "1-URGENT")
            for c, n in ((int(k[1:]), n) for k, n in counts.items()) for i in range(n)]
    spark.createDataFrame(rows, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING").coalesce(
        1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    return str(tmp_path), con


def test_component_arrays_beyond_the_planned_fields(spark, monkeypatch):
    monkeypatch.setattr(B, "LARGEST_FIELD", 8)
    rows = D.component_array(spark.createDataFrame([(1, 9), (2, 10), (3, 4)], "game_id BIGINT, n INT"), 1, "c")
    got = rows.groupBy("game_id", "sample").agg(F.countDistinct("player").alias("d"), F.max("pos").alias("m")).groupBy("game_id").agg(
        F.count("*"), F.min("d"), F.max("m")).collect()
    assert sorted(map(tuple, got)) == [(1, 72, 9, 9), (2, 110, 10, 10), (3, 12, 4, 4)]


def test_component_array_of_thousands_of_players(spark):
    path = D.component_array(spark.createDataFrame([(1, 4097)], "game_id BIGINT, n INT"), 1, "c").take(4097)
    assert len({r.sample for r in path}) == 1 and sorted(r.player for r in path) == list(range(4097))
    assert B.least_field(4097) == 4099 and B.least_field(4913) == 4913 and B.least_field(1) == 2


def test_component_array_mean_has_no_largest_game(spark, tmp_path):
    folder, con = orders_folder(spark, tmp_path, c1=3, c2=24, c3=48, c4=65)
    assert compare(QUERIES["component_array_mean"](spark, folder), ORACLES["component_array_mean"], con) == "ok"
    assert con.execute(f"SELECT count(*) FROM ({ORACLES['component_array_mean']}) x").fetchone() == (140,)


def test_stratified_differential_tells_every_pair_apart(spark, tmp_path):
    """Covering rows come first, so that no share is missing; shares sum to the value of all."""
    folder, con = orders_folder(spark, tmp_path, c1=1, c2=2, c3=9, c4=17)
    got = {}
    for r in QUERIES["stratified_differential"](spark, folder).collect():
        got.setdefault(r.game_id, []).append(r.share)
    assert {g: len(s) for g, s in got.items()} == {2: 2, 3: 9, 4: 17}
    for game, dearest in con.execute("SELECT o_custkey, max(floor(o_totalprice/1000)) FROM orders WHERE o_custkey > 1 GROUP BY 1").fetchall():
        assert None not in got[game] and sum(got[game]) == pytest.approx(dearest, abs=0.01)
