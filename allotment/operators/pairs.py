"""Estimators and diagnostics whose state is a table of player pairs.

The state is n*n per game (per size for the stratified form) by definition. Members are packed per (game, block) of
samples; a task turns the packs of an Arrow batch into matrix products, many small games at a time, and only sums per
pair leave it. No pairs of rows and no grid of all pairs are ever formed: what was not seen is told from counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from allotment.operators.designs import WHOLE, shuffle_partitions
from allotment.operators.skew import large

#: Cells of a matrix that a product takes or makes at a time.
CELLS = 2**20
#: Member entries of an Arrow batch that are taken at a time, in whole packs.
MEMBERS = 2**18


def _packs(sampled: DataFrame, weight: str | None = None) -> DataFrame:
    """Members per (game, block); coalitions without a value are not seen."""
    fields = [F.col("sample").cast("bigint").alias("sample"), F.col("size").cast("int").alias("size"), F.col("player").cast("int").alias("player"),
              F.col("value").cast("double").alias("value"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight")]
    return sampled.where("inside and value is not null").groupBy("game_id", "block").agg(
        F.first("n").cast("int").alias("n"), F.collect_list(F.struct(*fields)).alias("rows"))


def _sums(packs: DataFrame, by_size: bool, multiply, names: dict[str, str]) -> DataFrame:
    """`multiply(z, tile, value, weight)` of every pack as rows (game_id, size, i, j, *names), not yet summed over packs."""
    key = [("game_id", pa.int64()), ("size", pa.int32()), ("i", pa.int32()), ("j", pa.int32())]
    schema = pa.schema(key + [(name, pa.int64() if t == "BIGINT" else pa.float64()) for name, t in names.items()])

    def cells(batches):
        for batch in (part for whole in batches for part in pieces(whole)):
            packs, lengths = batch.column("rows"), batch.column("rows").value_lengths().to_numpy()
            flat = packs.flatten()
            game, n = (np.repeat(batch.column(c).to_numpy(), lengths) for c in ("game_id", "n"))
            field = {c: flat.field(c).to_numpy() for c in ("sample", "size", "player", "value", "weight")}
            size = field["size"] if by_size else np.zeros_like(field["size"])
            for g, s, i, j, sums in pair_sums(game, n, size, field["sample"], field["player"], field["value"], field["weight"], multiply):
                yield pa.record_batch([pa.array(a, t.type) for a, t in zip((g, s, i, j, *sums), schema)], schema=schema)

    ddl = "game_id BIGINT, size INT, i INT, j INT, " + ", ".join(f"{name} {t}" for name, t in names.items())
    return packs.mapInArrow(cells, ddl)


def pieces(batch: pa.RecordBatch):
    """A batch of packs in pieces of at most MEMBERS entries (or one pack), so that a task's memory does not grow with the batch."""
    upto = np.cumsum(batch.column("rows").value_lengths().to_numpy())
    lo = 0
    while lo < len(upto):
        hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + MEMBERS, "right")), lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def whole_games(sampled: DataFrame, finish, ddl: str, value: str | None = None) -> DataFrame:
    """`finish(ids, n, stacks)` of all games whose samples are in one block, many games at a time: their pairs never leave the task.

    `ids` are the games' numbers, `n` their players, the stacks (see `stacks`) name a game by its place among them. `finish`
    yields columns in the order of `ddl`. `value` is summed over coalitions; those without one are not seen. Games without a
    number are left out, as a join would. `sampled` has a row per player, or per coalition with its `members`.
    """
    listed = "members" in sampled.columns
    seen = f"block = {WHOLE} and game_id is not null" + ("" if listed else " and inside") + (f" and {value} is not null" if value else "")
    # The count keeps a game's rows together in one task, sorted, whatever the planner makes of the shuffles before it.
    entries = F.count(F.lit(1)).over(Window.partitionBy("game_id", "block"))
    rows = sampled.where(seen).select(
        "game_id", "block", F.col("n").cast("int").alias("n"), F.col("sample").cast("bigint").alias("sample"), F.col("size").cast("int").alias("size"),
        "members" if listed else F.col("player").cast("int").alias("player"), (F.col(value) if value else F.lit(0.0)).cast("double").alias("value"), entries.alias("entries"))
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def task(batches):
        for part in complete(batches):
            game, n, sample, size, value_ = (part.column(c).to_numpy() for c in ("game_id", "n", "sample", "size", "value"))
            first = np.flatnonzero(_starts(game))
            ids, players = game[first], n[first]
            place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(game))))
            if listed:
                members = part.column("members").combine_chunks()
                each = members.value_lengths().to_numpy()
                place, n, sample, size, value_ = (np.repeat(a, each) for a in (place, n, sample, size, value_))
                player = members.flatten().to_numpy()
            else:
                player = part.column("player").to_numpy()
            made = lambda by_size: stacks(place, n, size if by_size else np.zeros_like(size), sample, player, value_, size.astype(float), whole=True)
            for columns in finish(ids, players, made):
                yield pa.record_batch([pa.array(a, t.type) for a, t in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(task, ddl)


def complete(batches):
    """Batches of rows sorted by game as tables of whole games, of MEMBERS rows or so."""
    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many < (MEMBERS // 8 if "members" in batch.schema.names else MEMBERS):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        game = table.column("game_id").to_numpy()
        at = int(np.flatnonzero(game != game[-1]).max(initial=-1)) + 1
        if many - at == table.column("entries")[-1].as_py():
            at = many  # the last game is all there
        if at:
            yield table.slice(0, at)
            held, many = table.slice(at).to_batches(), many - at
    if many:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows begin a new key."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def stacks(game, n, size, sample, player, value, weight, whole: bool = False):
    """The coalitions of every (game, size) as 0/1 matrices, stacked for groups of like shape: yields (of, z, value, weight).

    `of` has the game and the size of every matrix of a stack. Takes one entry per member. A group with more than CELLS entries
    is stacked in parts, unless `whole`.
    """
    if len(game) == 0:
        return
    order = np.lexsort((sample, size, game))
    game, n, size, sample, player, value, weight = (a[order] for a in (game, n, size, sample, player, value, weight))
    new = _starts(game, size, sample)
    row = np.flatnonzero(new)
    fresh = _starts(game[row], size[row])
    place = np.arange(len(row)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    if not whole:
        fresh |= place % np.maximum(CELLS // n[row], 1) == 0
    group, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    place = np.arange(len(row)) - first[group]
    players, longest = n[row[first]], 2 ** np.ceil(np.log2(np.bincount(group))).astype(int)
    shape = np.lexsort((longest, players))
    rank = np.empty_like(shape)
    rank[shape] = np.arange(len(shape))
    # Coalitions and members in the order of the groups' shapes, so that a stack of groups is a range of both.
    by_row = np.argsort(rank[group], kind="stable")
    member = np.cumsum(new) - 1
    by_member = np.argsort(rank[group[member]], kind="stable")
    row_rank, member_rank = rank[group[by_row]], rank[group[member[by_member]]]
    lo = 0
    while lo < len(shape):
        width, height = int(players[shape[lo]]), int(longest[shape[lo]])
        room = max(CELLS // (width * max(width, height)), 1)
        same = (players[shape[lo:lo + room]] == width) & (longest[shape[lo:lo + room]] == height)
        hi = lo + (len(same) if same.all() else int(np.argmin(same)))
        rows = by_row[slice(*np.searchsorted(row_rank, [lo, hi]))]
        members = by_member[slice(*np.searchsorted(member_rank, [lo, hi]))]
        z = np.zeros((hi - lo, height, width))
        z[rank[group[member[members]]] - lo, place[member[members]], player[members]] = 1.0
        v, w = np.zeros((2, hi - lo, height, 1))
        v[rank[group[rows]] - lo, place[rows], 0], w[rank[group[rows]] - lo, place[rows], 0] = value[row[rows]], weight[row[rows]]
        of = row[first[shape[lo:hi]]]
        yield (game[of], size[of]), z, v, w
        lo = hi


def pair_sums(game, n, size, sample, player, value, weight, multiply):
    """Products of the coalitions of every (game, size), see `stacks`.

    A group with more than CELLS entries is multiplied in parts, each with sums of its own; a matrix with more than CELLS
    entries is made in tiles of players.
    """
    for (of_game, of_size), z, v, w in stacks(game, n, size, sample, player, value, weight):
        for tile in _tiles(z):
            sums, used = multiply(z, tile, v, w)
            g, i, j = np.nonzero(used)
            yield of_game[g], of_size[g], i + tile.start, j, [a[g, i, j] for a in sums]


def _tiles(z: np.ndarray) -> list[slice]:
    """Ranges of players so that a stack's matrices between them and all players have at most CELLS entries (or one player)."""
    step = max(CELLS // (z.shape[2] * len(z)), 1)
    return [slice(low, low + step) for low in range(0, z.shape[2], step)]


def _both(z, tile, v, w):
    """Count, value sum and weight sum of coalitions holding i and j."""
    left = z[:, :, tile].transpose(0, 2, 1)
    count = left @ z
    return (count.astype("int64"), left @ (z * v), left @ (z * w)), count


def _one_of(z, tile, v, w):
    """Count and value sum of coalitions with i and without j, and of those with j and without i."""
    left, out = z[:, :, tile].transpose(0, 2, 1), 1.0 - z
    miss = out[:, :, tile].transpose(0, 2, 1)
    seen, back = left @ out, miss @ z
    return (seen.astype("int64"), left @ (out * v), back.astype("int64"), miss @ (z * v)), seen + back


def co_membership(sampled: DataFrame, by_size: bool = False, weight: str | None = None) -> DataFrame:
    """Per (game, [size,] i, j): coalitions holding both, their value sum and weight sum.

    `sampled` has game_id, block, sample, size, player, inside, value, n.
    """
    level = ["game_id"] + (["size"] if by_size else [])
    names = {"count": "BIGINT", "total": "DOUBLE", "weighted": "DOUBLE"}
    return _sums(_packs(sampled, weight), by_size, _both, names).groupBy(*level, "i", "j").agg(*[F.sum(c).alias(c) for c in names])


def contrasts(sampled: DataFrame, by_size: bool = False) -> DataFrame:
    """Per (game, [size,] i, j), i != j: coalitions with i and without j (`seen`, `total`) and their mirror (`back`, `back_total`).

    Pairs that no coalition tells apart have no row. All pairs of one player are in one partition, so that sums per player
    need no further shuffle; a game's players are spread over the partitions.
    """
    level = ["game_id"] + (["size"] if by_size else [])
    names = {"seen": "BIGINT", "total": "DOUBLE", "back": "BIGINT", "back_total": "DOUBLE"}
    parts = _sums(_packs(sampled), by_size, _one_of, names).repartition(shuffle_partitions(), "game_id", "i")
    return parts.groupBy(*level, "i", "j").agg(*[F.sum(c).alias(c) for c in names])


def _swings(by_size: bool):
    """Per player of whole games: the sum of m_ij - m_ji over all j (and sizes) that are told apart both ways, and their number."""

    def finish(ids, n, made):
        start = np.cumsum(n) - n
        swing, covered = np.zeros(n.sum()), np.zeros(n.sum(), dtype=np.int64)
        for (game, _), z, v, w in made(by_size):
            for tile in _tiles(z):
                (seen, total, back, back_total), _ = _one_of(z, tile, v, w)
                both = (seen > 0) & (back > 0)
                gap = np.where(both, total / np.maximum(seen, 1) - back_total / np.maximum(back, 1), 0.0)
                at = start[game][:, None] + np.arange(tile.start, tile.start + gap.shape[1])
                np.add.at(swing, at, gap.sum(axis=2))
                np.add.at(covered, at, both.sum(axis=2))
        yield np.repeat(ids, n), np.arange(len(swing)) - np.repeat(start, n), swing, covered

    return finish


def _rest(sampled: DataFrame) -> DataFrame:
    """Rows of games in several blocks, or in blocks that nobody calls whole."""
    return sampled.where(f"block <> {WHOLE}")


def swing_sums(sampled: DataFrame, by_size: bool = False) -> DataFrame:
    """(game_id, player, swing, covered): sum over j of m_ij - m_ji where both were seen (at some size), and their number.

    Games whose samples are in one block are finished in their task; the others' pairs are summed over tasks.
    """
    whole = whole_games(sampled, _swings(by_size), "game_id BIGINT, player INT, swing DOUBLE, covered BIGINT", "value")
    if "members" in sampled.columns:
        return whole
    swing = F.col("total") / F.nullif(F.col("seen"), F.lit(0)) - F.col("back_total") / F.nullif(F.col("back"), F.lit(0))
    return contrasts(_rest(sampled), by_size).groupBy("game_id", F.col("i").alias("player")).agg(
        F.sum(swing).alias("swing"), F.count(swing).alias("covered")).unionByName(whole)


def differential(sampled: DataFrame, players: DataFrame, by_size: bool = False) -> DataFrame:
    """(f-e)/n + 1/n sum over j of (m_ij - m_ji); by_size averages that over the n-1 sizes.

    m_ij is the mean value of coalitions with i and without j. The share is null when some
    ordered pair (at some size) was never seen. `players` has game_id, player, n and endpoints.
    """
    return differential_shares(swing_sums(sampled, by_size), players, by_size)


def differential_shares(sums: DataFrame, players: DataFrame, by_size: bool) -> DataFrame:
    """`differential` of the sums per player."""
    ends = players.select("game_id", "player", "n", "empty_value", "full_value")
    levels = F.col("n").cast("bigint") - 1 if by_size else F.lit(1)
    pairs = F.col("n").cast("bigint") * (F.col("n") - 1) * levels
    joined = ends.join(large(sums), ["game_id", "player"], "left").withColumn("covered", F.sum("covered").over(Window.partitionBy("game_id")))
    share = F.when(F.col("n") == 1, F.lit(0.0)).when(F.col("covered") == pairs, F.col("swing") / (F.col("n") * levels))
    return joined.select("game_id", "player", ((F.col("full_value") - F.col("empty_value")) / F.col("n") + share).alias("share"))


def pair_coverage(sampled: DataFrame, players: DataFrame, by_size: bool = False) -> DataFrame:
    """Ordered pairs covered, and the least and most coalitions per pair."""
    games = players.where("player = 0 and n > 1").select("game_id", "n")
    level = ["game_id"] + (["size"] if by_size else [])
    if by_size:
        games = games.withColumn("size", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    counts = contrasts(sampled, by_size).groupBy(*level).agg(
        F.sum((F.col("seen") > 0).cast("bigint")).alias("covered"), F.min("seen").alias("least"), F.max("seen").alias("most"))
    pairs = F.col("n").cast("bigint") * (F.col("n") - 1)
    found = games.join(large(counts), level, "left").fillna(0, ["covered", "least", "most"])
    return found.select(*level, pairs.alias("pairs"), "covered", F.when(F.col("covered") == pairs, F.col("least")).otherwise(0).alias("least"), "most")


def kernel_moments(sampled: DataFrame) -> DataFrame:
    """Gram rows of KernelSHAP: count of i and j together, and on the diagonal the sum of v - e with i.

    Sizes come from the kernel law, so rows are unweighted.
    """
    centred = sampled.withColumn("value", F.col("value") - F.col("empty_value"))
    return co_membership(centred).select("game_id", "i", "j", "count", "total")


def kernel_shap(sampled: DataFrame, players: DataFrame, ridge: float = 0.0) -> DataFrame:
    """Least squares on the sampled rows under the constraint that shares sum to f - e.

    The data-sized part is the Gram; one small solve per game runs in parallel over games.
    """
    moments = kernel_moments(sampled)
    ends = players.where("player = 0").select("game_id", "n", (F.col("full_value") - F.col("empty_value")).alias("target"))
    packed = moments.groupBy("game_id").agg(*[F.collect_list(c).alias(c) for c in ("i", "j", "count", "total")])
    packed = ends.join(large(packed), "game_id", "left").repartition(shuffle_partitions(), "game_id")

    def solve(batches):
        for pdf in batches:
            games, players, shares = [], [], []
            for r in pdf.itertuples(index=False):
                n = int(r.n)
                gram, rhs = np.zeros((n, n)), np.zeros(n)
                if r.i is not None:
                    gram[r.i, r.j] = r.counts
                    own = r.i == r.j
                    rhs[r.i[own]] = r.total[own]
                games.append(np.full(n, r.game_id))
                players.append(np.arange(n))
                shares.append(constrained_fit(gram, rhs, float(r.target), ridge))
            if games:
                yield pd.DataFrame({"game_id": np.concatenate(games), "player": np.concatenate(players), "share": np.concatenate(shares)})

    return packed.withColumnRenamed("count", "counts").mapInPandas(solve, "game_id BIGINT, player INT, share DOUBLE")


def constrained_fit(gram: np.ndarray, rhs: np.ndarray, target: float, ridge: float) -> np.ndarray:
    """Minimise x'Gx - 2 rhs'x + ridge |x|^2 with sum(x) = target; the least-norm answer if rank is short."""
    n = len(rhs)
    start = np.full(n, target / n)
    centre = np.eye(n) - 1.0 / n
    inner = centre @ gram @ centre
    slope = centre @ (rhs - gram @ start)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    usable = values > np.finfo(float).eps * n * max(values.max(initial=0.0), 1.0)
    along = vectors.T @ slope
    if ridge > 0:
        step = np.where(usable, along / (np.maximum(values, 0) + ridge), along / ridge)
    else:
        step = np.where(usable, along / np.where(usable, values, 1.0), 0.0)
    share = start + centre @ (vectors @ step)
    return share + (target - share.sum()) / n
