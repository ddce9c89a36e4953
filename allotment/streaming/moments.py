"""Online moments over arriving blocks of permutation pairs, with Structured Streaming.

Blocks are parquet files of (game_id, pair, player, contribution). The running state is six numbers per player, and a
pair that arrives twice counts once. Every trigger writes the players it touched as one epoch folder. A trigger that is
repeated after a failure overwrites its own folder. After some triggers a snapshot folds all epochs so far into the
newest state of every player and removes them, so reading the state costs one snapshot and a few epochs, however long
the stream has run. Progress per epoch is one row per game in a table of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allotment.operators.analytics import reference_moments

BLOCK_SCHEMA = "game_id BIGINT, pair BIGINT, player INT, contribution DOUBLE"
STATE_SCHEMA = "game_id BIGINT, player INT, count BIGINT, total DOUBLE, squares DOUBLE, first_total DOUBLE, first_count BIGINT, epoch BIGINT"
PROGRESS_SCHEMA = "game_id BIGINT, pairs BIGINT, epoch BIGINT"
#: The state that knows every pair is on the executors' disks, not in their heaps; a trigger saves what it changed.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
               "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}
COLUMNS = ["game_id", "player", "count", "total", "squares", "first_total", "first_count"]


def write_blocks(contributions: DataFrame, folder: str, block: Column) -> None:
    """Append blocks as one sub-folder each."""
    rows = contributions.select("game_id", F.col("pair").cast("bigint").alias("pair"), "player", "contribution", block.alias("arrival"))
    rows.repartition("arrival").write.mode("append").partitionBy("arrival").parquet(folder)


class Folder:
    """A folder on whatever file system the session's Hadoop configuration names for it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.place = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self) -> bool:
        return self.system.exists(self.place)

    def numbered(self, prefix: str) -> dict[int, str]:
        """Finished sub-folders `prefix`-<number>, by number."""
        if not self.exists():
            return {}
        names = [status.getPath().getName() for status in self.system.listStatus(self.place)]
        found = {int(n.rsplit("-", 1)[1]): f"{self.path}/{n}" for n in names if n.startswith(f"{prefix}-")}
        return {k: p for k, p in sorted(found.items()) if Folder(self.spark, f"{p}/_SUCCESS").exists()}

    def delete(self) -> None:
        self.system.delete(self.place, True)


def check_configuration(spark: SparkSession, folder: str, key: str) -> None:
    """Refuse to resume a stream that was started with another configuration."""
    path = f"{folder}/configuration"
    if Folder(spark, path).exists():
        if spark.read.schema("key STRING").json(path).where(F.col("key") != key).count():
            raise ValueError("the saved stream belongs to another configuration")
    else:
        spark.range(1).select(F.lit(key).alias("key")).write.json(path)


def newest(rows: DataFrame) -> DataFrame:
    latest = rows.groupBy("game_id", "player").agg(F.max_by(F.struct(*COLUMNS[2:], "epoch"), "epoch").alias("s"))
    return latest.select("game_id", "player", "s.*")


def saved(spark: SparkSession, work: str) -> DataFrame:
    """The last snapshot and the epochs after it: a player's newest row is its state."""
    state = Folder(spark, f"{work}/state")
    snapshots, epochs = state.numbered("snapshot"), state.numbered("epoch")
    last = max(snapshots, default=-1)
    paths = [p for k, p in snapshots.items() if k == last] + [p for k, p in epochs.items() if k > last]
    return spark.read.schema(STATE_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], STATE_SCHEMA)


def fold(spark: SparkSession, work: str, epoch: int) -> None:
    """Write the snapshot of `epoch`, then remove what it replaces.

    Until its success mark is there, readers use the older snapshot and epochs; after it, they ignore them.
    """
    newest(saved(spark, work)).write.mode("overwrite").parquet(f"{work}/state/snapshot-{epoch}")
    state = Folder(spark, f"{work}/state")
    for number, path in [*state.numbered("epoch").items(), *((k, p) for k, p in state.numbered("snapshot").items() if k < epoch)]:
        if number <= epoch:
            Folder(spark, path).delete()


def commit(work: str, fold_after: int):
    """Batch sink: one epoch folder of touched players, one of progress, and a snapshot once `fold_after` epochs are open."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        folders = Folder(spark, f"{work}/state").numbered("snapshot")
        if epoch <= max(folders, default=-1):
            return  # repeated after its snapshot was written: everything is in there
        path = f"{work}/state/epoch-{epoch}"
        batch.select(*COLUMNS, F.lit(epoch).cast("bigint").alias("epoch")).write.mode("overwrite").parquet(path)
        written = spark.read.schema(STATE_SCHEMA).parquet(path)
        written.groupBy("game_id").agg(F.max("count").alias("pairs"), F.first("epoch").alias("epoch")).write.mode(
            "overwrite").parquet(f"{work}/progress/epoch-{epoch}")
        if len(Folder(spark, f"{work}/state").numbered("epoch")) >= fold_after:
            fold(spark, work, epoch)

    return write


def run_moments(spark: SparkSession, blocks: str, work: str, half_pairs: int, key: str, files_per_trigger: int = 1,
                state_partitions: int | None = None, fold_after: int = 16) -> None:
    """Consume all blocks that have arrived and stop; calling it again goes on from the checkpoint.

    The first start fixes the number of state partitions for good: state_partitions, or else the session's shuffle partitions.
    A new block may repeat pairs of any earlier one, so the state that knows them has no end; it grows with the pairs.
    """
    check_configuration(spark, work, key)
    arriving = (
        spark.readStream.schema(BLOCK_SCHEMA + ", arrival INT").option("maxFilesPerTrigger", files_per_trigger).parquet(blocks)
        .dropDuplicates(["game_id", "pair", "player"])
    )
    state = reference_moments(arriving, F.col("pair") < half_pairs).select(*COLUMNS)
    settings = {"spark.sql.shuffle.partitions": str(state_partitions or spark.conf.get("spark.sql.shuffle.partitions")), **STATE_STORE}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", f"{work}/checkpoint")
            .trigger(availableNow=True).foreachBatch(commit(work, fold_after)).start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def current_state(spark: SparkSession, work: str) -> DataFrame:
    """The newest state of every player, read between runs."""
    return newest(saved(spark, work)).drop("epoch")


def progress(spark: SparkSession, work: str, pairs_per_game: int) -> DataFrame:
    """Completed fraction of the pairs after every epoch, per game the epoch touched."""
    paths = Folder(spark, f"{work}/progress").numbered("epoch").values()
    rows = spark.read.schema(PROGRESS_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], PROGRESS_SCHEMA)
    return rows.select("game_id", "epoch", "pairs", (F.col("pairs") / pairs_per_game).alias("fraction"))
