"""Sampled rows are made, ranked and summed as few times as the work needs."""

from pyspark.sql import functions as F

from allotment.functions.laws import INNER
from allotment.operators import balanced as G
from allotment.operators import designs as D
from allotment.operators import estimators as E
from allotment.operators import utilities as U
from allotment.operators.skew import Split


def _players(spark, games=6):
    rows = spark.range(games).select(F.col("id").alias("game_id"), (F.col("id") % 3 + 4).cast("int").alias("n"))
    rows = rows.withColumn("player", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return E.boundary_part(U.boundary(Split(rows.withColumn("cost", (F.col("player") * 7 + F.col("game_id")) % 5)), U.max_cost()))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rank_and_size_share_a_window(spark):
    players = _players(spark).map(lambda df, hot: df.localCheckpoint())
    sized = D.iid_design(players, 8, "w", INNER).rows()
    assert _plan(sized.select("game_id", "pos", "size")).count("Window [") == 1
    apart = D.with_sizes(D.random_order(players, 8, "w"), D.law_draws(INNER, "w")).rows()
    keys = ["game_id", "sample", "player", "pos", "size"]
    assert sorted(sized.select(*keys).collect()) == sorted(apart.select(*keys).collect())


def test_partitions_grow_with_the_samples(spark):
    players = _players(spark)
    parts = [D.spread(players, samples).rows().rdd.getNumPartitions() for samples in (1, 24, 96)]
    assert parts == [D.shuffle_partitions() * times for times in (1, 1, 4)]
    assert D.spread(players, 0).rows().count() == 0


def test_linear_estimates_of_one_sample_share_its_rows(spark):
    from allotment.catalog import QUERIES
    from conftest import FOLDER
    assert _plan(QUERIES["oracle_profile_gap"](spark, FOLDER)).count("AS pos#") == 1
    sampled = E.with_size_profile(U.evaluate(D.iid_design(_players(spark), 24, "l", INNER), U.max_cost()))
    both = {(r.game_id, r.player): (r.a, r.b) for r in E.linear_by(sampled, a="endpoint", b="profile").collect()}
    for at, profile in enumerate(("endpoint", "profile")):
        alone = E.linear(sampled, profile).collect()
        assert len(alone) == len(both) and all(abs(both[r.game_id, r.player][at] - r.share) < 1e-9 for r in alone)


def test_complements_are_listed_only_for_their_readers(spark):
    games = spark.createDataFrame([(1, 2), (2, 7), (3, 8), (None, 5)], "game_id BIGINT, n INT")
    parts = D.partition_blocks(games, "p")
    lines = [line for line in _plan(parts.where("complement = 0")).splitlines() if "array_except" in line or "array_contains" in line]
    assert all("CASE WHEN (complement" in line for line in lines)
    pairs = {}
    for r in parts.collect():
        assert len(r.members) == r["size"] == (r.n - r.base_size if r.complement else r.base_size)
        pairs.setdefault((r.game_id, r.base_size, r.part), []).append(r.members)
        assert r.members == sorted(set(r.members))
    n = {1: 2, 2: 7, 3: 8, None: 5}
    assert all(sorted(a + b) == list(range(n[game])) for (game, _, _), (a, b) in pairs.items())


def test_fills_of_a_batch_leave_no_ordered_pair_out(spark):
    games = spark.createDataFrame([(1, 2), (2, 7), (3, 8), (None, 5)], "game_id BIGINT, n INT")
    parts = D.partition_blocks(games, "p").where("complement = 0").select("game_id", "n", F.col("base_size").alias("size"), "members")
    fills = G.fill_pairs(parts, "p")
    assert "MapInArrow" in _plan(fills)
    rows = fills.select("game_id", "n", "size", "members").unionByName(parts).collect()
    seen = {}
    for r in rows:
        assert len(r.members) == r["size"] and r.members == sorted(set(r.members))
        out = set(range(r.n)) - set(r.members)
        own = seen.setdefault((r.game_id, r.n, r["size"]), set())
        own |= {(i, j) for i in r.members for j in out}
        if 2 * r["size"] == r.n:
            own |= {(j, i) for i in r.members for j in out}
    assert all(len(own) == n * (n - 1) for (_, n, _), own in seen.items()) and len(seen) == 1 + 3 + 4 + 2
    numbers = [(r.game_id, r["size"], r["sample"]) for r in fills.collect()]
    assert len(numbers) == len(set(numbers))


def test_partition_blocks_are_made_in_all_partitions(spark):
    games = spark.range(40).select(F.col("id").alias("game_id"), F.lit(6).alias("n")).coalesce(1)
    tasks = D.partition_blocks(games, "p").select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == D.shuffle_partitions() > 1
