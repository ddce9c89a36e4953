"""Sampling designs in long form: one row per (game, sample, player).

Samples of a game are cut into blocks of about SAMPLE_ROWS rows. The only shuffle
is on (game_id, block), of player rows before they are multiplied by the samples;
ranks, utilities and partial sums then stay inside the partition.
"""

from __future__ import annotations

from typing import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from allotment.functions.hashing import first_in_order, order_key, uniform
from allotment.functions.laws import SizeLaw
from allotment.operators.skew import Split, attach, in_a_row, key_bucket, large, rank_rows

SAMPLE_ROWS = 262_144
#: Samples of a game that one of `shuffle_partitions()` is to hold; with more there are more partitions, so that none has to spill.
PART_SAMPLES = 24
SAMPLE = ["game_id", "block", "sample"]
#: The block of a game whose samples are all in one block; the blocks of other games count from 0.
WHOLE = -1


def shuffle_partitions() -> int:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(players: Split, samples: int | Column) -> Split:
    """Repeat the players of every game for samples 0..T-1, cut into blocks."""
    total = (F.lit(samples) if isinstance(samples, int) else samples).cast("bigint")

    def step(df: DataFrame, hot: bool) -> DataFrame:
        df = df.withColumn("samples", total).withColumn(
            "_per", F.greatest(F.lit(1), F.floor(F.lit(SAMPLE_ROWS) / F.col("n"))).cast("bigint"))
        df = df.where("samples > 0").withColumn(
            "block", F.explode(F.when(F.col("samples") <= F.col("_per"), F.array(F.lit(WHOLE).cast("bigint"))).otherwise(
                F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("samples") / F.col("_per")) - 1))))
        if not hot:
            # A fixed number of partitions: these rows are few but are about to multiply.
            times = -(-samples // PART_SAMPLES) if isinstance(samples, int) else 1
            df = df.repartition(shuffle_partitions() * max(times, 1), "game_id", "block")
        first = F.greatest(F.col("block"), F.lit(0)) * F.col("_per")
        last = F.least(F.col("samples"), first + F.col("_per")) - 1
        return df.withColumn("sample", F.explode(F.sequence(first, last))).drop("_per")

    return players.map(step)


def random_order(players: Split, samples: int | Column, seed: str) -> Split:
    """Random permutations, keyed by sample: adds `pos` 1..n and the sort `key`."""

    def step(df: DataFrame, hot: bool) -> DataFrame:
        df = df.withColumn("key", order_key(seed, F.col("game_id"), F.col("sample"), F.col("player")))
        bucket = key_bucket("key", F.col("n")) if hot else F.lit(0)
        return rank_rows(df, SAMPLE, ["key", "player"], bucket, "pos", hot)

    return spread(players, samples).map(step)


def antithetic(players: Split, pairs: int | Column, seed: str) -> Split:
    """Each permutation and its reverse: sample = 2*pair + direction."""

    def step(df: DataFrame, hot: bool) -> DataFrame:
        df = df.withColumn("pair", F.col("sample")).withColumn("direction", F.explode(F.array(F.lit(0), F.lit(1))))
        back = F.col("direction") == 1
        return (
            df.withColumn("sample", F.col("pair") * 2 + F.col("direction"))
            .withColumn("pos", F.when(back, F.col("n") + 1 - F.col("pos")).otherwise(F.col("pos")))
            .withColumn("key", F.when(back, F.lit(16**15 - 1) - F.col("key")).otherwise(F.col("key")))
        )

    return random_order(players, pairs, seed).map(step)


def sized_order(players: Split, samples: int | Column, seed: str, size: Callable[[], Column]) -> Split:
    """`random_order` and `with_sizes`; ordinary games take rank and size off one window."""

    def step(df: DataFrame, hot: bool) -> DataFrame:
        df = df.withColumn("key", order_key(seed, F.col("game_id"), F.col("sample"), F.col("player")))
        if hot:
            return rank_rows(df, SAMPLE, ["key", "player"], key_bucket("key", F.col("n")), "pos", hot)
        order = Window.partitionBy(*SAMPLE).orderBy("key", "player")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumn("_size", F.when(F.col("player") == 0, size()))
        return df.select("*", F.row_number().over(order).alias("pos"), F.max("_size").over(whole).alias("size")).drop("_size")

    ordered = spread(players, samples).map(step)
    return Split(ordered.cold, None if ordered.hot is None else with_sizes(Split(ordered.cold, ordered.hot), size).hot)


def with_sizes(sampled: Split, size: Callable[[], Column]) -> Split:
    """Give every sample one size: computed on the row of player 0 and shared with the rest."""

    def step(df: DataFrame, hot: bool) -> DataFrame:
        df = df.withColumn("_size", F.when(F.col("player") == 0, size()))
        return attach(df, SAMPLE, hot, size=F.max("_size")).drop("_size")

    return sampled.map(step)


def mark_inside(ordered: Split) -> Split:
    """The first `size` players of the random order form the coalition."""
    return ordered.map(lambda df, hot: df.withColumn("inside", F.col("pos") <= F.col("size")))


def law_draws(law: SizeLaw, seed: str) -> Callable[[], Column]:
    return lambda: law.draw(uniform(seed, F.lit("size"), F.col("game_id"), F.col("sample")), F.col("n"))


def iid_design(players: Split, samples: int | Column, seed: str, law: SizeLaw) -> Split:
    """Sizes drawn independently from a law, members uniform given the size."""
    return mark_inside(sized_order(players, samples, seed, law_draws(law, seed)))


def uniform_size_draw(seed: str) -> Callable[[], Column]:
    return lambda: (F.floor(uniform(seed, F.lit("size"), F.col("game_id"), F.col("sample")) * F.col("n")) + 1).cast("int")


def complement_design(players: Split, pairs: int | Column, seed: str) -> Split:
    """Complement pairs: size uniform on 1..n; `inside` is S, the other rows are N without S."""
    return mark_inside(sized_order(players, pairs, seed, uniform_size_draw(seed)))


def systematic_schedule(games: DataFrame, samples: int | Column, seed: str, law: SizeLaw) -> DataFrame:
    """(game, sample, size) with size counts at the floor or ceiling of T*q, in random sample order.

    Ranks are computed in blocks of hashed order keys, so a game with very many samples
    is not sorted by one task.
    """
    total = (F.lit(samples) if isinstance(samples, int) else samples).cast("bigint")
    games = games.repartition(shuffle_partitions(), "game_id")
    steps = games.withColumn("samples", total).withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("samples") - 1)))
    start = uniform(seed, F.lit("start"), F.col("game_id"))
    point = start + F.col("step") / F.col("samples")
    sized = (
        steps.withColumn("size", law.draw(point - F.floor(point), F.col("n")))
        .withColumn("key", order_key(seed, F.lit("shuffle"), F.col("game_id"), F.col("step")))
        .withColumn("chunk", key_bucket("key", F.col("samples")).cast("int"))
    )
    before = Window.partitionBy("game_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sized.groupBy("game_id", "chunk").agg(F.count(F.lit(1)).alias("_rows"))
        .select("game_id", "chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("game_id", "chunk").orderBy("key", "step")
    return (
        sized.withColumn("_rank", F.row_number().over(within))
        .join(large(offsets), ["game_id", "chunk"])
        .select("game_id", "n", "samples", (F.col("_rank") + F.col("_offset") - 1).alias("sample"), "size")
    )


def scheduled_design(players: Split, schedule: DataFrame, samples: int | Column, seed: str) -> Split:
    """Members uniform given the sizes of a schedule (game_id, sample, size)."""
    sizes = schedule.select("game_id", "sample", "size")

    def step(df: DataFrame, hot: bool) -> DataFrame:
        return df.join(large(sizes), ["game_id", "sample"])

    return mark_inside(random_order(players, samples, seed).map(step))


def coalition_arrays(sampled: DataFrame, carry: list[str] = ()) -> DataFrame:
    """One row per coalition with its sorted members, for designs whose n fits in a row."""
    return sampled.where("inside").groupBy("game_id", "sample", "size").agg(
        F.sort_array(F.collect_list("player")).alias("members"), *[F.first(c).alias(c) for c in carry])


def size_law_table(games: DataFrame, law: SizeLaw) -> DataFrame:
    """(n, size, share, low, high): the law and its CDF for every number of players that occurs."""
    sizes = games.select("n").distinct().where(F.col("n") >= law.first + law.last).select(
        "n", law.total(F.col("n")).alias("normaliser"), F.explode(law.sizes(F.col("n"))).alias("size"))
    share = law.weight(F.col("size"), F.col("n")) / F.col("normaliser")
    up = Window.partitionBy("n").orderBy("size")
    return sizes.withColumn("share", share).withColumn("high", F.sum("share").over(up)).withColumn(
        "low", F.col("high") - F.col("share"))


def boundary_coalitions(players: DataFrame) -> DataFrame:
    """The 2n+2 boundary coalitions, kept implicit as (kind, player)."""
    own = F.array(F.struct(F.lit("single").alias("kind"), F.col("player").alias("member"), F.lit(1).alias("size")),
                  F.struct(F.lit("loo").alias("kind"), F.col("player").alias("member"), (F.col("n") - 1).alias("size")))
    ends = F.array(F.struct(F.lit("empty").alias("kind"), F.lit(None).cast("int").alias("member"), F.lit(0).alias("size")),
                   F.struct(F.lit("full").alias("kind"), F.lit(None).cast("int").alias("member"), F.col("n").alias("size")))
    rows = players.withColumn("c", F.explode(F.when(F.col("player") == 0, F.concat(ends, own)).otherwise(own)))
    return rows.select("game_id", "c.kind", F.col("c.member").alias("player"), "c.size")


def hash_permutation(n: Column, *parts) -> Column:
    """A permutation of 0..n-1 inside a row, ordered by hash."""
    return F.transform(
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.struct(order_key(*parts, p).alias("k"), p.alias("p")))),
        lambda e: e["p"])


def _first_fixed(n: Column, *parts) -> Column:
    """A hash-ordered permutation that keeps 0 in front."""
    keyed = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.struct(
        F.when(p == 0, F.lit(-1)).otherwise(order_key(*parts, p)).alias("k"), p.alias("p")))
    return F.transform(F.sort_array(keyed), lambda e: e["p"])


def with_own(games: DataFrame, players: DataFrame) -> DataFrame:
    """Games, or orders in arrays, with the columns of their players in one array `own`: path rows take them along and are not shuffled."""
    return games.join(large(in_a_row(players, *[c for c in players.columns if c not in ("game_id", "player")])), "game_id")


def _cut_rows(blocks: DataFrame, rows: Column) -> DataFrame:
    """Deal the `rows` orders of every design block out in parts of about SAMPLE_ROWS places: adds `block` and `row`."""
    per = F.greatest(F.lit(1), F.floor(F.lit(SAMPLE_ROWS) / F.col("n"))).cast("bigint")
    b = blocks.withColumn("_rows", rows.cast("bigint")).withColumn("_per", per).withColumn("_parts", F.ceil(F.col("_rows") / F.col("_per")))
    b = b.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    b = b.withColumn("block", F.col("design_block") * F.col("_parts") + F.col("_part")).repartition(shuffle_partitions(), "game_id", "block")
    return b.withColumn("_first", F.col("_part") * F.col("_per")).drop("_part", "_parts")


def _part_rows() -> Column:
    return F.sequence(F.col("_first"), F.least(F.col("_rows"), F.col("_first") + F.col("_per")) - 1)


def path_rows(orders: DataFrame) -> DataFrame:
    """Rows (pos, player) of array orders `players`; where an order takes its game's players along (`own`), with their columns.

    The rows stay where the order is. Orders name players 0..n-1; a place without a player in `own` has no row.
    """
    keep = [c for c in orders.columns if c not in ("players", "own")]
    if "own" not in orders.columns:
        return orders.select(*keep, F.inline(F.transform("players", lambda p, at: F.struct((at + 1).alias("pos"), p.alias("player")))))
    fields = [c for c in orders.schema["own"].dataType.elementType.names if c != "player"]
    places = F.transform("players", lambda p, at: F.struct((at + 1).alias("pos"), p.alias("player"), F.get("own", p).alias("_own")))
    rows = orders.select(*[c for c in keep if c not in fields], F.inline(places)).where("_own is not null")
    return rows.select("*", *[F.col(f"_own.{c}").alias(c) for c in fields]).drop("_own")


def latin_square(games: DataFrame, blocks: int | Column, seed: str) -> DataFrame:
    """Per block n permutations: cyclic shifts of a random base with shuffled rows and columns.

    Rows are (game_id, n, design_block, block, sample, pos, player) and the players' columns where `games` came `with_own`.
    """
    total = F.lit(blocks) if isinstance(blocks, int) else blocks
    n, own = F.col("n"), [c for c in games.columns if c == "own"]
    b = games.select("game_id", "n", *own).withColumn("design_block", F.explode(F.sequence(F.lit(0), total.cast("int") - 1)))
    b = _cut_rows(b, n)
    tag = [F.col("game_id"), F.col("design_block")]
    b = b.withColumn("base", _first_fixed(n, seed, F.lit("base"), *tag)).withColumn(
        "cols", hash_permutation(n, seed, F.lit("cols"), *tag)).withColumn("rows", _first_fixed(n, seed, F.lit("rows"), *tag))
    b = b.withColumn("row", F.explode(_part_rows())).withColumn("turn", F.col("rows")[F.col("row").cast("int")])
    return path_rows(b.select("game_id", "n", "design_block", "block", (F.col("design_block") * n + F.col("row")).cast("bigint").alias("sample"), *own,
                              F.transform("cols", lambda c: F.col("base")[(F.col("turn") + c) % n]).alias("players")))


def component_array(games: DataFrame, blocks: int | Column, seed: str) -> DataFrame:
    """Per block q(q-1) permutations a + m*c over GF(q), q the least prime power >= n, for games of any size.

    Symbols >= n are dummies and are dropped; positions close up. For prime q this is modular arithmetic. Proper prime powers
    multiply by adding logarithms and add digit by digit, within a row; one row per number of players that occurs, and one of
    powers and logarithms per field, is what is broadcast. Columns as in `latin_square`.
    """
    from allotment.functions.fields import field_row
    from allotment.plans.budget import least_field
    total = F.lit(blocks) if isinstance(blocks, int) else blocks
    q, own = F.col("q"), [c for c in games.columns if c == "own"]
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    orders = [(r.n, least_field(r.n)) for r in games.select("n").where("n is not null").distinct().collect()]
    used = [field_row(order) for order in sorted({order for _, order in orders})]
    fields = F.broadcast(spark.createDataFrame(used, "q BIGINT, p INT, places ARRAY<INT>, powers ARRAY<INT>, logs ARRAY<INT>"))
    b = games.select("game_id", "n", *own).join(F.broadcast(spark.createDataFrame(orders, "n INT, q BIGINT")), "n")
    b = b.withColumn("design_block", F.explode(F.sequence(F.lit(0), total.cast("int") - 1)))
    b = _cut_rows(b, q * (q - 1)).withColumn("cols", _first_fixed(q.cast("int"), seed, F.lit("coa"), F.col("game_id"), F.col("design_block")))
    b = b.join(fields, "q").withColumn("row", F.explode(_part_rows()))
    b = b.withColumn("a", F.floor(F.col("row") / (q - 1)).cast("bigint")).withColumn("m", F.col("row") % (q - 1) + 1)
    digit = lambda x, w: F.floor(x / w).cast("int") % F.col("p")
    at = lambda c: ((F.get("logs", F.col("m").cast("int")).cast("bigint") + F.get("logs", c)) % (q - 1)).cast("int")
    times = lambda c: F.when(c == 0, 0).otherwise(F.get("powers", at(c)))
    plus = lambda x: F.aggregate("places", F.lit(0), lambda s, w: s + (digit(x, w) + digit(F.col("a"), w)) % F.col("p") * w)
    player = lambda c: F.when(F.col("p") == q, ((F.col("a") + F.col("m") * c) % q).cast("int")).otherwise(plus(times(c)))
    players = F.filter(F.transform("cols", player), lambda x: x < F.col("n"))
    return path_rows(b.select("game_id", "n", "design_block", "block",
                              (F.col("design_block") * q * (q - 1) + F.col("row")).cast("bigint").alias("sample"), *own, players.alias("players")))


def candidate_pool(games: DataFrame, size: Column, pool: int, seed: str, used: DataFrame) -> DataFrame:
    """Distinct coalitions of a size per game that are not in `used` (game_id, members)."""
    drawn = games.withColumn("size", size.cast("int")).withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(pool - 1))))
    order = hash_permutation(F.col("n"), seed, F.col("game_id"), F.col("candidate"))
    drawn = drawn.withColumn("members", F.sort_array(F.slice(order, F.lit(1), F.col("size"))))
    fresh = drawn.groupBy("game_id", "size", "members").agg(F.min("candidate").alias("candidate"))
    return fresh.join(large(used.select("game_id", "members")), ["game_id", "members"], "left_anti")


def relabel(coalitions: DataFrame, seed: str) -> DataFrame:
    """Rename the players of a whole design by one random permutation per game."""
    labels = hash_permutation(F.col("n"), seed, F.lit("relabel"), F.col("game_id"))
    # One-row inline: the labels are computed once per row instead of once per member.
    return coalitions.select("*", F.inline(F.array(F.struct(labels.alias("labels"))))).withColumn(
        "members", F.sort_array(F.transform("members", lambda m: F.col("labels")[m]))).drop("labels")


def cyclic_orbit(bases: DataFrame) -> DataFrame:
    """All n shifts of every base coalition."""
    n = F.col("n")
    shifted = bases.withColumn("shift", F.explode(F.sequence(F.lit(0), n - 1)))
    return shifted.withColumn("members", F.sort_array(F.transform("members", lambda m: (m + F.col("shift")) % n)))


def random_bases(games: DataFrame, counts: DataFrame, seed: str) -> DataFrame:
    """Random orbit bases: one uniform coalition per (game, size, orbit); `counts` has game_id, n, size, count."""
    rows = counts.withColumn("orbit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)))
    order = hash_permutation(F.col("n"), seed, F.lit("base"), F.col("game_id"), F.col("size"), F.col("orbit"))
    return rows.select("game_id", "n", "size", "orbit", F.sort_array(F.slice(order, F.lit(1), F.col("size"))).alias("members"))


def partition_blocks(games: DataFrame, seed: str) -> DataFrame:
    """S-Diff start: for every size s <= n/2 a permutation cut into ceil(n/s) wrap-around blocks, with complements."""
    n, s = F.col("n"), F.col("size")
    sizes = games.where("n >= 2").withColumn("size", F.explode(F.sequence(F.lit(1), F.floor(n / 2).cast("int"))))
    # A game is a few bytes and becomes n*n members or more: the planner's own partitions would be one or two.
    sizes = sizes.repartition(shuffle_partitions(), "game_id", "size")
    sizes = sizes.withColumn("order", hash_permutation(n, seed, F.lit("sdiff"), F.col("game_id"), s))
    cut = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(n / s).cast("int") - 1)))
    block = F.transform(F.sequence(F.lit(0), s - 1), lambda k: F.col("order")[(F.col("part") * s + k) % n])
    cut = cut.withColumn("block_members", F.sort_array(block))
    # Complements are listed after the sides are told apart: who reads only the blocks does not pay for them.
    rest = F.array_except(F.sequence(F.lit(0), n - 1), F.col("block_members"))
    sides = cut.withColumn("complement", F.explode(F.array(F.lit(0), F.lit(1))))
    members = F.when(F.col("complement") == 0, F.col("block_members")).otherwise(rest)
    size = F.when(F.col("complement") == 0, s).otherwise(n - s)
    return sides.select("game_id", "n", s.alias("base_size"), "part", "complement", members.alias("members"), size.alias("size"))


def predecessor_samples(counts: DataFrame, seed: str) -> DataFrame:
    """For every cell (player, size) its share of samples: `size` predecessors from the other players.

    The player itself sorts last; `predecessors` are the first `size` of the hash order.
    """
    draws = counts.where("count > 0").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)))

    def before(batches):
        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in ("game_id", "player", "size", "draw")))
            n, size, player = (batch.column(c).to_numpy() for c in ("n", "size", "player"))
            listed = first_in_order([(seed, *own) for own in names], n, size, player)
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], [*batch.schema.names, "predecessors"])

    schema = StructType(draws.schema.fields + [StructField("predecessors", ArrayType(IntegerType()))])
    return draws.mapInArrow(before, schema)


def reverse_pairs(orders: DataFrame) -> DataFrame:
    """Forward and reverse paths of array permutations (game_id, n, pair, players), as rows or with `own` with the players' columns."""
    own = [c for c in orders.columns if c == "own"]
    rows = orders.repartition(shuffle_partitions(), "game_id", "pair").withColumn("direction", F.explode(F.array(F.lit(0), F.lit(1))))
    order = F.when(F.col("direction") == 1, F.reverse("players")).otherwise(F.col("players"))
    return path_rows(rows.select("game_id", "n", "pair", F.col("pair").alias("block"), (F.col("pair") * 2 + F.col("direction")).alias("sample"), *own, order.alias("players")))


def all_orders(games: DataFrame, limit: int = 8) -> DataFrame:
    """All n! permutations of every game as path rows, as `latin_square`; n must not exceed `limit`."""
    own = [c for c in games.columns if c == "own"]
    n = F.when(F.col("n") <= limit, F.col("n")).otherwise(
        F.raise_error(F.lit(f"all orders need at most {limit} players")).cast("int"))
    spread = games.withColumn("n", n).repartition(shuffle_partitions(), "game_id")
    rows = spread.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("bigint"), F.factorial(n) - 1)))
    # The sample number in factorial digits picks, place by place, one of the players still left.
    start = F.struct(F.sequence(F.lit(0), F.col("n") - 1).alias("left"), F.array().cast("array<int>").alias("picked"),
                     F.col("sample").alias("code"))

    def pick(acc, k):
        left = acc["left"]
        at = (acc["code"] % k).cast("int")
        return F.struct(F.concat(F.slice(left, F.lit(1), at), F.slice(left, at + 2, F.size(left))).alias("left"),
                        F.concat(acc["picked"], F.array(left[at])).alias("picked"), F.floor(acc["code"] / k).alias("code"))

    order = F.aggregate(F.sequence(F.col("n"), F.lit(1), F.lit(-1)), start, pick)["picked"]
    return path_rows(rows.select("game_id", "n", F.lit(0).cast("bigint").alias("block"), "sample", *own, order.alias("players")))
