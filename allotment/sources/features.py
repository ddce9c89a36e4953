"""Labelled points: balanced subsets, splits and training-only scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allotment.functions.hashing import order_key
from allotment.operators.skew import key_bucket, rank_rows, split_games


def balanced_subset(points: DataFrame, per_class: int, seed: str) -> DataFrame:
    """`per_class` rows of every label in hash order; a label with fewer rows is an error.

    The rank filter is a top-k per label, which Spark applies before the shuffle.
    """
    keyed = points.withColumn("key", order_key(seed, F.col("point_id")))
    first = Window.partitionBy("label").orderBy("key", "point_id")
    picked = keyed.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_class)
    counts = points.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "rows", F.when(F.col("rows") >= per_class, F.col("rows")).otherwise(F.raise_error(F.lit("a class has too few rows")).cast("bigint")))
    return picked.join(counts, "label").select("point_id", "label", "rank", "rows")


def class_ranks(points: DataFrame, seed: str) -> DataFrame:
    """Hash-order rank of every point within its label, and the label's rows; large labels are ranked in buckets."""
    keyed = points.withColumn("key", order_key(seed, F.col("point_id")))
    counts = keyed.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))

    def step(df: DataFrame, hot: bool) -> DataFrame:
        df = df.join(counts, "label")
        return rank_rows(df, ["label"], ["key", "point_id"], key_bucket("key", F.col("rows")) if hot else F.lit(0), "rank", hot)

    return split_games(keyed, "key", game="label").map(step).rows()


def stratified_split(points: DataFrame, test_share: float, seed: str) -> DataFrame:
    """Per label, the first ceil(test_share * rows) in hash order are test rows."""
    ranked = class_ranks(points, seed)
    test = F.col("rank") <= F.ceil(F.lit(test_share) * F.col("rows"))
    return ranked.withColumn("split", F.when(test, "test").otherwise("train"))


def round_robin_split(points: DataFrame, valued: int, performance: int, seed: str) -> DataFrame:
    """Deal the labels in turn: the first `valued` points are valued, the next `performance` score them.

    Round r deals every label its r-th point, and each round has a point, so only the first valued + performance points of a
    label can have a place. Rounds are ordered by label on their own; the sizes of earlier rounds, as many rows as there are
    places to give, set them off.
    """
    ranked = class_ranks(points, seed).where(F.col("rank") <= valued + performance)
    sizes = ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("dealt"))
    earlier = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("rank", F.coalesce(F.sum("dealt").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("rank").orderBy("label"))
    place = ranked.withColumn("within", within).join(F.broadcast(before), "rank").withColumn("place", F.col("before") + F.col("within"))
    role = F.when(F.col("place") <= valued, "valued").when(F.col("place") <= valued + performance, "performance")
    return place.withColumn("role", role).where("role is not null").select("point_id", "label", "place", "role")


def standardise(points: DataFrame, places: int = 9) -> DataFrame:
    """Scale features by the mean and deviation of the training rows; constant features drop out.

    The statistics are one row with an entry per feature, no wider than a point is, which bounds their broadcast.
    """
    train = points.where("split = 'train'").select(F.posexplode("features").alias("feature", "x"))
    stats = train.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    table = stats.where(F.round("sd", places) > 0).agg(F.sort_array(F.collect_list(F.struct("feature", "mean", "sd"))).alias("stats")).withColumn("one", F.lit(1))
    joined = points.withColumn("one", F.lit(1)).join(F.broadcast(table), "one").drop("one")
    scaled = F.transform("stats", lambda s: (F.col("features")[s["feature"]] - s["mean"]) / s["sd"])
    return joined.withColumn("kept", F.col("stats.feature")).withColumn("features", scaled).drop("stats")
