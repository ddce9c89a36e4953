"""Utilities that train a small model on a coalition's data and score it.

Players are shards of training rows. Nearest centroid needs only per-shard label sums, so
it is joins and sums. Logistic models are fitted on all rows of a coalition's shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allotment.functions.hashing import order_key

#: Rows below which a task of a gradient step is not split.
TASK_ROWS = 4096


def shard_sums(train: DataFrame) -> DataFrame:
    """Per (player, label, feature): rows and feature sum of the shard, in one partial aggregation."""
    long = train.select("player", "label", F.posexplode("features").alias("feature", "x"))
    return long.groupBy("player", "label", "feature").agg(F.count(F.lit(1)).alias("rows"), F.sum("x").alias("total"))


def centroids(members: DataFrame, sums: DataFrame) -> DataFrame:
    """Class centroids of every coalition: (sample, label, centroid array, rows)."""
    met = members.select("sample", "player").join(sums, "player")
    means = met.groupBy("sample", "label", "feature").agg((F.sum("total") / F.sum("rows")).alias("mean"), F.sum("rows").alias("rows"))
    return means.groupBy("sample", "label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("feature", "mean"))), lambda e: e["mean"]).alias("centroid"), F.first("rows").alias("rows"))


def centroid_accuracy(test: DataFrame, models: DataFrame, samples: int) -> DataFrame:
    """Share of test points whose nearest centroid has their label; ties go to the lower label.

    A model row packs the centroids of one coalition (labels x features numbers). Test points
    stay where they are; models, of a size that the data does not change, are joined to them.
    """
    packed = models.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("label", "centroid"))).alias("model"))
    rows = test.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint"))))
    distance = lambda c: F.aggregate(F.zip_with("features", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d)
    best = F.array_min(F.transform("model", lambda m: F.struct(F.round(distance(m["centroid"]), 9).alias("d"), m["label"].alias("label"))))
    hits = rows.join(packed, "sample").withColumn("hit", (best["label"] == F.col("label")).cast("bigint"))
    return hits.groupBy("sample").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("points")).withColumn(
        "value", F.col("hits") / F.col("points"))


def best_constant(test: DataFrame) -> DataFrame:
    """Accuracy of the most frequent test label: the value of the empty coalition."""
    counts = test.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    return counts.agg((F.max("rows") / F.sum("rows")).alias("value"))


def classes(train: DataFrame, test: DataFrame) -> list:
    """The labels that occur, in order."""
    found = train.select("label").unionByName(test.select("label")).where("label is not null").distinct()
    return sorted(r["label"] for r in found.collect())


def logistic_models(members: DataFrame, train: DataFrame, labels: list, seed: str, *, one_pass: bool,
                    steps: int = 60, rate: float = 0.5) -> DataFrame:
    """A softmax model per coalition, (sample, weights): one row of feature weights and a bias per label of `labels`.

    Every model is trained on every labelled row of its shards; rows stay where they are, and the models (samples x
    labels x features numbers, held by the driver) go to them. Full gradient: one job per step, with a partial sum per
    task. one_pass: one update per row. A coalition takes its shards in an order seeded by its members and the rows of a
    shard in hash order of point_id; one job per turn serves all coalitions, so a shard is one task. A coalition with
    one class predicts that class, one without rows has no model.
    """
    known = F.array(*[F.lit(v) for v in labels])
    rows = train.where("label is not null").select("player", (F.array_position(known, F.col("label")) - 1).cast("int").alias("y"), "features", "point_id")
    counts = {}
    for r in rows.groupBy("player", "y").agg(F.count(F.lit(1)).alias("rows"), F.first(F.size("features")).alias("width")).collect():
        counts.setdefault(r["player"], {})[r["y"]] = r["rows"]
        width = r["width"]
    spark = train.sparkSession
    schema = "sample BIGINT, weights ARRAY<ARRAY<DOUBLE>>"
    inside = {}
    for r in members.select("sample", "player").collect():
        if r["player"] in counts:
            inside.setdefault(r["sample"], []).append(r["player"])
    if not inside:
        return spark.createDataFrame([], schema)
    weights, open_ = {}, {}
    for sample, held in inside.items():
        weights[sample] = np.zeros((width + 1, len(labels)))
        held.sort()
        seen = sorted({y for p in held for y in counts[p]})
        if len(seen) == 1:
            weights[sample][-1] = np.where(np.arange(len(labels)) == seen[0], 0.0, -30.0)
        else:
            open_[sample] = held
    tasks = train.sparkSession.sparkContext.defaultParallelism
    if one_pass:
        order = order_key(seed, F.col("point_id"))
        rows = rows.repartition(len(counts), "player").sortWithinPartitions("player", order, "point_id")
    else:
        rows = rows.repartition(max(1, min(2 * tasks, sum(sum(c.values()) for c in counts.values()) // TASK_ROWS)))
    rows = rows.drop("point_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        (_passes if one_pass else _descent)(rows, open_, weights, counts, seed, steps, rate)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(s, w.T.tolist()) for s, w in sorted(weights.items())], schema)


def _arrays(batch):
    """Players, features with a one behind, and label numbers of an Arrow batch."""
    x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return batch.column(0).to_numpy(), np.column_stack([x, np.ones(len(x))]), batch.column(1).to_numpy()


def _descent(rows, inside, weights, counts, seed, steps, rate):
    """Gradient steps of all coalitions at once."""
    samples, players = sorted(inside), sorted(counts)
    if not samples:
        return
    share = np.zeros((len(players), len(samples)))
    for i, s in enumerate(samples):
        share[np.searchsorted(players, inside[s]), i] = 1 / sum(sum(counts[p].values()) for p in inside[s])
    state = np.stack([weights[s] for s in samples], axis=1)  # features x samples x labels

    def job(now):
        def task(batches):
            total = np.zeros_like(now)
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    player, x, y = _arrays(batch.slice(at, 2048))
                    p = softmax((x @ now.reshape(len(now), -1)).reshape(-1, now.shape[2])).reshape(len(x), *now.shape[1:])
                    rest = (np.eye(now.shape[2])[y][:, None, :] - p) * share[np.searchsorted(players, player)][:, :, None]
                    total += (x.T @ rest.reshape(len(x), -1)).reshape(now.shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])
        return sum(np.frombuffer(r["part"], dtype=float).reshape(now.shape) for r in rows.mapInArrow(task, "part BINARY").collect())

    for _ in range(steps):
        state = state + rate * job(state)
    for i, s in enumerate(samples):
        weights[s] = state[:, i]


def _passes(rows, inside, weights, counts, seed, steps, rate):
    """One update per row, shard after shard."""
    from allotment.operators.balanced import generator
    turns = {s: [held[i] for i in generator(seed, *held).permutation(len(held))] for s, held in inside.items()}

    def job(due):
        def task(batches):
            done = {}
            for batch in batches:
                player, x, y = _arrays(batch)
                for p in np.unique(player):
                    if p not in due:
                        continue
                    if p not in done:
                        done[p] = np.stack([w for _, w in due[p]])
                    now, hot = done[p], np.eye(done[p].shape[2])
                    for i in np.flatnonzero(player == p):
                        now += rate * x[i][None, :, None] * (hot[y[i]] - softmax(x[i] @ now))[:, None, :]
            names = [(s, w) for p, now in done.items() for (s, _), w in zip(due[p], now)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in names], pa.int64()), pa.array([w.tobytes() for _, w in names], pa.binary())], ["sample", "part"])
        return rows.mapInArrow(task, "sample BIGINT, part BINARY").collect()

    for turn in range(max(map(len, turns.values()), default=0)):
        due = {}
        for s, held in turns.items():
            if turn < len(held):
                due.setdefault(held[turn], []).append((s, weights[s]))
        for r in job(due):
            weights[r["sample"]] = np.frombuffer(r["part"], dtype=float).reshape(weights[r["sample"]].shape).copy()


def logistic_scores(test: DataFrame, models: DataFrame, labels: list, samples: int) -> DataFrame:
    """Accuracy and mean log-likelihood of every model on all labelled test rows."""
    known = F.array(*[F.lit(v) for v in labels])
    rows = test.where("label is not null").withColumn("label", (F.array_position(known, F.col("label")) - 1).cast("int")).withColumn("sample", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint"))))
    dot = lambda w: F.aggregate(F.zip_with(F.concat("features", F.array(F.lit(1.0))), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    logits = rows.join(models, "sample").select("sample", "label", F.inline(F.array(F.struct(F.transform("weights", dot).alias("z")))))
    top = F.array_max("z")
    spread = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max("z")))
    own = F.col("z")[F.col("label")]
    scored = logits.select("sample", (own == top).cast("bigint").alias("hit"), (own - top - F.log(spread)).alias("ll"))
    return scored.groupBy("sample").agg(F.avg("hit").alias("accuracy"), F.avg("ll").alias("log_likelihood"))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
