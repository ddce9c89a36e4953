"""Orders by hash keys that Python makes in whole Arrow batches are those of the column expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from allotment.functions.hashing import first_in_order, order_keys
from allotment.operators import balanced as G
from allotment.operators import covered_pairs as C
from allotment.operators import designs as D


def test_order_keys_are_those_of_the_columns(spark):
    from allotment.functions.hashing import order_key
    rows = spark.createDataFrame([(7, 2), (None, 3), (-1, 0)], "g BIGINT, s INT").withColumn("p", F.explode(F.array(*[F.lit(i) for i in range(12)])))
    want = {(r.g, r.s, r.p): r.k for r in rows.withColumn("k", order_key("seed", F.col("g"), F.col("s"), F.col("p"))).collect()}
    for g, s in ((7, 2), (None, 3), (-1, 0)):
        assert order_keys([("seed", g, s)], 12)[0].tolist() == [want[g, s, p] for p in range(12)]


def test_first_in_order_leaves_numbers_out():
    got = first_in_order([("a", 1), ("a", 2), ("b", None)], np.array([5, 3, 5]), np.array([4, 0, 2]), np.array([1, 0, 4])).to_pylist()
    assert [len(x) for x in got] == [4, 0, 2] and sorted(got[0]) == [0, 2, 3, 4] and 4 not in got[2]
    assert first_in_order([], np.array([], int), np.array([], int)).to_pylist() == []


def test_random_coalitions_are_hashed_in_batches(spark):
    runs = spark.createDataFrame([(1, 5, 40), (None, 9, 30), (3, 4, 0)], "game_id BIGINT, n INT, random_calls BIGINT")
    rows = C.random_rows(runs, "r")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "md5" not in plan.split("MapInArrow")[0]
    order = D.hash_permutation(F.col("n"), "r", F.lit("rows"), F.col("game_id"), F.col("sample"))
    again = rows.withColumn("again", F.slice(order, F.lit(1), F.col("size"))).collect()
    assert len(again) == 70 and all(r.members == r.again and len(r.members) == r["size"] for r in again)


def test_predecessors_are_hashed_in_batches(spark):
    counts = spark.createDataFrame([(g, p, 4, s, 2) for g in (1, None) for p in range(4) for s in range(4)], "game_id BIGINT, player INT, n INT, size INT, count BIGINT")
    rows = D.predecessor_samples(counts, "m")
    assert "MapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString()
    others = F.filter(D.hash_permutation(F.col("n"), "m", F.col("game_id"), F.col("player"), F.col("size"), F.col("draw")), lambda p: p != F.col("player"))
    got = rows.withColumn("again", F.slice(others, F.lit(1), F.col("size"))).collect()
    assert len(got) == 64 and all(r.predecessors == r.again for r in got)


@pytest.mark.parametrize("cells", [1, 2**20])
def test_fills_do_not_depend_on_the_slices_beside_them(spark, monkeypatch, cells):
    games = spark.createDataFrame([(g, n) for g, n in enumerate([7, 7, 8, 8, 8, 12, 12, 3])], "game_id BIGINT, n INT").coalesce(1)
    parts = D.partition_blocks(games, "p").where("complement = 0").select("game_id", "n", F.col("base_size").alias("size"), "members")
    monkeypatch.setattr(G, "CELLS", cells)
    keys = lambda rows: sorted((r.game_id, r["size"], r["sample"], tuple(r.members)) for r in rows)
    together = keys(G.fill_pairs(parts, "f").collect())
    assert together and keys(r for g in range(8) for r in G.fill_pairs(parts.where(f"game_id = {g}"), "f").collect()) == together
