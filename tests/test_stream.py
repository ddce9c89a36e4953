"""Online moments: repeated epochs, snapshots, restarts."""

import random

from pyspark.sql import functions as F

from allotment.operators.analytics import reference_moments
from allotment.streaming import moments as M

PAIRS = 12


def contributions(spark):
    draw = random.Random(7)
    rows = [(g, p, i, float(draw.randrange(-50, 50))) for g in range(3) for p in range(PAIRS) for i in range(4)]
    return spark.createDataFrame(rows, "game_id long, pair long, player int, contribution double")


def arrive(rows, folder, low, high):
    M.write_blocks(rows.where((F.col("pair") >= low) & (F.col("pair") < high)), folder, F.floor(F.col("pair") / 2).cast("int"))


def told(df):
    return sorted(map(tuple, df.select(*M.COLUMNS).collect()))


def test_snapshots_keep_the_state(spark, tmp_path):
    """Six triggers with a snapshot every two, in two runs with a block sent twice, equal one batch aggregate."""
    rows, blocks, work = contributions(spark), str(tmp_path / "blocks"), str(tmp_path / "work")
    arrive(rows, blocks, 0, 6)
    M.run_moments(spark, blocks, work, 6, "k", 1, 4, fold_after=2)
    arrive(rows, blocks, 4, PAIRS)
    M.run_moments(spark, blocks, work, 6, "k", 1, 4, fold_after=2)
    assert told(M.current_state(spark, work)) == told(reference_moments(rows, F.col("pair") < 6))
    state = M.Folder(spark, f"{work}/state")
    assert len(state.numbered("snapshot")) == 1
    assert len(state.numbered("epoch")) <= 1
    seen = M.progress(spark, work, PAIRS).groupBy("game_id").agg(F.max("fraction").alias("f"), F.count("*").alias("c")).collect()
    assert {(r.f, r.c) for r in seen} == {(1.0, 6)}  # the repeated block touches nobody


def batch(rows, pairs):
    return reference_moments(rows.where(F.col("pair") < pairs), F.col("pair") < 6)


def test_repeated_epochs_change_nothing(spark, tmp_path):
    rows, work = contributions(spark), str(tmp_path / "work")
    write = M.commit(work, 3)
    for epoch in (0, 0, 1, 1, 2, 2, 1, 0):  # also after epoch 2 was folded
        write(batch(rows, 2 * epoch + 2), epoch)
    assert told(M.current_state(spark, work)) == told(batch(rows, 6))
    write(batch(rows, 8), 3)
    write(batch(rows, 8), 3)
    assert told(M.current_state(spark, work)) == told(batch(rows, 8))


def test_an_unfinished_snapshot_is_ignored(spark, tmp_path):
    rows, work = contributions(spark), str(tmp_path / "work")
    write = M.commit(work, 9)
    write(batch(rows, 4), 0)
    write(batch(rows, 8), 1)
    batch(rows, 2).withColumn("epoch", F.lit(1).cast("bigint")).write.parquet(f"{work}/state/snapshot-1")
    (tmp_path / "work/state/snapshot-1/_SUCCESS").unlink()
    assert told(M.current_state(spark, work)) == told(batch(rows, 8))
    M.fold(spark, work, 1)
    assert told(M.current_state(spark, work)) == told(batch(rows, 8))
    assert not M.Folder(spark, f"{work}/state").numbered("epoch")


def test_no_block_yet(spark, tmp_path):
    assert M.current_state(spark, str(tmp_path)).count() == 0
    assert M.progress(spark, str(tmp_path), PAIRS).count() == 0


def test_state_of_pairs_is_on_disk(spark, tmp_path):
    """The state store of a stream is not the heap's; the session's settings are as before."""
    rows, blocks, work = contributions(spark), str(tmp_path / "blocks"), str(tmp_path / "work")
    before = {name: spark.conf.get(name, None) for name in [*M.STATE_STORE, "spark.sql.shuffle.partitions"]}
    arrive(rows, blocks, 0, 4)
    M.run_moments(spark, blocks, work, 6, "k", 1, 3)
    assert {name: spark.conf.get(name, None) for name in before} == before
    assert "RocksDBStateStoreProvider" in (tmp_path / "work/checkpoint/offsets/0").read_text()
    assert told(M.current_state(spark, work)) == told(batch(rows, 4))
