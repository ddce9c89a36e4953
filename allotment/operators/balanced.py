"""Balanced designs: coalitions picked one after another so that the set stays even.

Each pick depends on the picks before it, so one slice (a size of a game, or a game where
one balance runs over all sizes) is a sequential loop from its first row to its last.
Slices share no state. They are rows of a specification table that Spark computes and
spreads; every task turns its own specification rows into coalitions, slices with the same
number of players in lock step. Every row keeps its
uniform law through the relabelling.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allotment.functions.laws import INNER, SizeLaw
from allotment.operators.designs import shuffle_partitions, systematic_schedule
from allotment.operators.skew import in_a_row, large
from allotment.plans.budget import minimum_one_counts

ENUMERATE_UP_TO = 2048
CELLS = 1 << 20  # numbers held for the slices that are picked together
SCHEMA = "game_id BIGINT, design STRING, n INT, sample BIGINT, size INT, members ARRAY<INT>"


def generator(*parts) -> np.random.Generator:
    """A random stream named by content, the same wherever the slice runs."""
    digest = hashlib.md5("|".join(map(str, parts)).encode()).digest()
    return np.random.default_rng(np.frombuffer(digest, dtype=np.uint32))


@lru_cache(maxsize=256)
def all_subsets(n: int, size: int) -> np.ndarray:
    """Every subset of one size as 0/1 rows."""
    members = np.array(list(combinations(range(n), size)))
    rows = np.zeros((len(members), n))
    np.put_along_axis(rows, members, 1.0, axis=1)
    rows.flags.writeable = False
    return rows


class CandidatePool:
    """Draws K distinct unused subsets of one size; starts over once all have been used."""

    def __init__(self, n: int, size: int, rng: np.random.Generator, reuse: bool = False):
        self.n, self.size, self.rng, self.reuse = n, size, rng, reuse
        self.total = comb(n, size)
        self.used: set[bytes] = set()
        self.start_over()

    def start_over(self) -> None:
        self.used.clear()
        self.table = all_subsets(self.n, self.size) if self.total <= ENUMERATE_UP_TO else None
        self.free = None if self.table is None else np.ones(self.total, dtype=bool)

    def listed(self, k: int) -> bool:
        """Whether the next draw of k goes by a table."""
        if self.table is None and self.total - len(self.used) <= 2 * k:
            self.list_rest()  # drawing at random would look for the last ones for ever
        return self.table is not None

    def draw(self, k: int) -> np.ndarray:
        if self.listed(k):
            left = np.flatnonzero(self.free)
            self.drawn = left if len(left) <= k else np.sort(left[self.rng.choice(len(left), k, replace=False)])
            return self.table[self.drawn]
        found: dict[bytes, np.ndarray] = {}
        while len(found) < k:
            (rows,), (marks,) = random_subsets([self], k)
            self.find(rows, marks, k, found)
        self.drawn = list(found)
        return np.stack(list(found.values()))

    def find(self, rows: np.ndarray, marks: list[bytes], k: int, found: dict[bytes, np.ndarray]) -> None:
        """Add the unused ones among randomly drawn rows to `found`, up to k."""
        for i, mark in enumerate(marks):
            if mark not in self.used and mark not in found:
                found[mark] = rows[i]
                if len(found) == k:
                    return

    def list_rest(self) -> None:
        """Goes on with a table of the few unused subsets."""
        rest = []
        for members in combinations(range(self.n), self.size):
            row = np.zeros(self.n)
            row[list(members)] = 1.0
            if row_marks(row[None])[0] not in self.used:
                rest.append(row)
        self.table = np.stack(rest)
        self.free = np.ones(len(rest), dtype=bool)

    def take(self, index: int) -> None:
        if self.reuse:
            return
        if self.table is None:
            self.used.add(self.drawn[index])
            return
        self.free[self.drawn[index]] = False
        if len(self.drawn) == 1 and not self.free.any():  # one left is drawn alone
            self.start_over()


def row_marks(rows: np.ndarray) -> list:
    """0/1 rows as bytes, in the shape of the leading axes."""
    packed = np.packbits(rows.astype(bool), axis=-1)
    return packed.view(f"S{packed.shape[-1]}")[..., 0].tolist()


def random_subsets(pools: list[CandidatePool], k: int) -> tuple[np.ndarray, list[list[bytes]]]:
    """2k random subsets for each of some pools alike in n and size, with their marks."""
    n, size = pools[0].n, pools[0].size
    picks = np.argpartition(np.stack([p.rng.random((2 * k, n)) for p in pools]), size, axis=-1)[..., :size]
    rows = np.zeros((len(pools), 2 * k, n))
    np.put_along_axis(rows, picks, 1.0, axis=-1)
    return rows, row_marks(rows)


def draw_together(pools: list[CandidatePool], k: int) -> list[np.ndarray]:
    """`draw` of each pool; random subsets of pools alike in size are made together."""
    out: list = [None] * len(pools)
    alike: dict[int, list[int]] = {}
    for at, p in enumerate(pools):
        if p.listed(k):
            out[at] = p.draw(k)
        else:
            alike.setdefault(p.size, []).append(at)
    for ats in alike.values():
        rows, marks = random_subsets([pools[at] for at in ats], k)
        for at, own, names in zip(ats, rows, marks):
            p, found = pools[at], {}
            p.find(own, names, k, found)
            while len(found) < k:
                (more,), (names,) = random_subsets([p], k)
                p.find(more, names, k, found)
            p.drawn = list(found)
            out[at] = np.stack(list(found.values()))
    return out


def direction(z: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Unit directions of 0/1 rows (slice, candidate, player) of the slices' sizes s."""
    n = z.shape[-1]
    return np.sqrt(n / (s * (n - s)))[:, None, None] * (z - (s / n)[:, None, None])


class PairBalance:
    """Scores w * u'Au + lambda * <u, sum of u at that size> of slices that are picked in lock step.

    scope 'size': one unweighted operator per size. scope 'all': one operator for all rows, each row weighted by sqrt(s(n-s)).
    """

    def __init__(self, n: int, mean_weights: list[float], frame_weight: float, scope: str):
        self.mean, self.frame_weight, self.scope = np.array(mean_weights), frame_weight, scope
        self.sums = np.zeros((len(mean_weights), n if scope == "all" else 1, n))
        self.frame = np.zeros((len(mean_weights), n, n)) if frame_weight else None

    def score(self, at: np.ndarray, s: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = direction(z, s)
        scores = self.mean[at][:, None] * np.matmul(u, self.sums[at, self._row(s)][..., None])[..., 0]
        if self.frame is not None:
            scores = scores + (self.frame_weight * self._weight(s))[:, None] * (np.matmul(u, self.frame[at]) * u).sum(axis=-1)
        return scores, u

    def add(self, at: np.ndarray, s: np.ndarray, u: np.ndarray) -> None:
        self.sums[at, self._row(s)] += u
        if self.frame is not None:
            self.frame[at] += self._weight(s)[:, None, None] * (u[:, :, None] * u[:, None, :])

    def _row(self, s: np.ndarray) -> np.ndarray:
        return s if self.scope == "all" else np.zeros_like(s)

    def _weight(self, s: np.ndarray) -> np.ndarray:
        return np.sqrt(s * (s.dtype.type(self.sums.shape[-1]) - s)) if self.scope == "all" else np.ones(len(s))


class ShiftBalance:
    """Scores of bases whose shift signatures are to cancel, of slices that are picked in lock step."""

    def __init__(self, n: int, count: int, weighted: bool):
        self.total, self.weighted = np.zeros((count, n)), weighted

    def score(self, at: np.ndarray, s: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = z.shape[-1]
        w = np.sqrt(s * (n - s)) if self.weighted else np.ones(len(s))
        signature = w[:, None, None] * shift_signature(z, s)
        return np.matmul(2 * signature, self.total[at][..., None])[..., 0] + (signature**2).sum(axis=-1), signature

    def add(self, at: np.ndarray, s: np.ndarray, signature: np.ndarray) -> None:
        self.total[at] += signature


def shift_signature(z: np.ndarray, s: np.ndarray) -> np.ndarray:
    """First row of the mean operator of all cyclic shifts, for 0/1 rows (slice, candidate, player) of sizes s."""
    n = z.shape[-1]
    spectrum = np.fft.rfft(direction(z, s), axis=-1)
    return np.fft.irfft(np.abs(spectrum) ** 2, n=n, axis=-1) / n


def lock_step(n: int, sizes: list[np.ndarray], rngs: list, pool: int, balance, reuse: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pick rows for the size sequences of slices of n players, the lowest score first, ties at random.

    Slices share no state and no randomness: each picks as it would alone, the next row of all of them is scored at once.
    Returns 0/1 rows per slice; with `reuse` (candidates stay in the pool) also a random pick from each pool.
    """
    chosen = [np.zeros((len(own), n), dtype=bool) for own in sizes]
    control = [np.zeros((len(own), n), dtype=bool) for own in sizes] if reuse else []
    pools: list[dict[int, CandidatePool]] = [{} for _ in sizes]
    for step in range(max(map(len, sizes), default=0)):
        active = [at for at, own in enumerate(sizes) if len(own) > step]
        used = []
        for at in active:
            s = int(sizes[at][step])
            if s not in pools[at]:
                pools[at][s] = CandidatePool(n, s, rngs[at], reuse)
            used.append(pools[at][s])
        drawn = draw_together(used, pool)
        alike: dict[int, list[int]] = {}
        for i, z in enumerate(drawn):
            alike.setdefault(len(z), []).append(i)
        for group in alike.values():
            z = np.stack([drawn[i] for i in group])
            at, s = np.array([active[i] for i in group]), np.array([used[i].size for i in group])
            scores, moved = balance.score(at, s, z)
            low = scores.min(axis=1, keepdims=True)
            tied = scores <= low + 1e-14 + 1e-12 * abs(low)
            best = tied.argmax(axis=1)
            for g in np.flatnonzero(tied.sum(axis=1) > 1).tolist():
                ties = np.flatnonzero(tied[g])
                best[g] = ties[used[group[g]].rng.integers(0, len(ties))]
            each = np.arange(len(group))
            balance.add(at, s, moved[each, best])
            for g, row in enumerate(z[each, best]):
                used[group[g]].take(int(best[g]))
                chosen[at[g]][step] = row
                if reuse:
                    control[at[g]][step] = z[g, int(used[group[g]].rng.integers(z.shape[1]))]
    return chosen, control


def greedy_rows(n: int, sizes: list[int], rng, pool: int, mean_weight: float, frame_weight: float, scope: str) -> list[np.ndarray]:
    """The members of the rows that one slice picks, see `PairBalance`."""
    (rows,), _ = lock_step(n, [np.asarray(sizes)], [rng], pool, PairBalance(n, [mean_weight], frame_weight, scope))
    return [np.flatnonzero(row) for row in rows]


def _run(spec: DataFrame, work) -> DataFrame:
    """Spread specification rows and turn each into coalitions."""

    def task(batches):
        for pdf in batches:
            rows = [r for spec_row in pdf.itertuples(index=False) for r in work(spec_row)]
            if rows:
                yield pd.DataFrame(rows, columns=["game_id", "design", "n", "sample", "size", "members"])

    return spec.repartition(shuffle_partitions()).mapInPandas(task, SCHEMA)


def _run_together(spec: DataFrame, pool: int, work) -> DataFrame:
    """Spread specification rows and turn those alike in n into coalitions together.

    `work(n, rows)` yields (arm, row, samples, 0/1 rows of coalitions) for specification rows as dicts. Rows are taken in parts
    whose candidates and operators stay within CELLS numbers. `name` is the game in the names of random streams: its number, in
    a batch with a null game as a float, as pandas has it.
    """

    def task(batches):
        for batch in batches:
            numbers, names = batch.column("n").to_numpy(), batch.column("game_id").to_pandas().tolist()
            for n in np.unique(numbers).tolist():
                own = np.flatnonzero(numbers == n)
                per = max(1, CELLS // ((2 * pool + 2 * n) * n))
                for first in range(0, len(own), per):
                    at = own[first:first + per]
                    part = [{**row, "name": names[i]} for i, row in zip(at, batch.take(pa.array(at)).to_pylist())]
                    made = list(work(n, part))
                    games = np.concatenate([np.full(len(rows), row["game_id"]) for _, row, _, rows in made])
                    rows = np.concatenate([rows for *_, rows in made])
                    ends = np.zeros(len(rows) + 1, dtype=np.int32)
                    np.cumsum(rows.sum(axis=1), out=ends[1:])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(games, pa.int64()), pa.array([arm for arm, _, samples, _ in made for _ in samples]),
                         pa.array(np.full(len(rows), n), pa.int32()),
                         pa.array(np.concatenate([np.asarray(samples, dtype=np.int64) for _, _, samples, _ in made])),
                         pa.array(np.diff(ends), pa.int32()),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(rows)[1], pa.int32()))],
                        ["game_id", "design", "n", "sample", "size", "members"])

    return spec.repartition(shuffle_partitions()).mapInArrow(task, SCHEMA)


def _relabelled(rows: np.ndarray, *parts) -> np.ndarray:
    """0/1 rows with the players renamed by a random permutation named by `parts`."""
    out = np.empty_like(rows)
    out[:, generator(*parts).permutation(rows.shape[1])] = rows
    return out


def _slices(schedule: DataFrame, keys: list[str]) -> DataFrame:
    """Group a schedule into slices: the samples of a game that share the keys, in order."""
    return schedule.groupBy("game_id", "n", *keys).agg(F.sort_array(F.collect_list(F.struct("sample", "size"))).alias("plan"))


def mean_balance(schedule: DataFrame, lambda0: float, mode: str = "normalized", radial: bool = False) -> DataFrame:
    """lambda_eff = lambda0 (1 - 1/(n-1)) mean(w^2) per game, w^2 = s(n-s) if radial, else 1."""
    weight = (F.col("size") * (F.col("n") - F.col("size"))).cast("double") if radial else F.lit(1.0)
    factor = (1 - 1 / (F.col("n") - 1)) * F.col("mean_weight_squared")
    out = schedule.groupBy("game_id", "n").agg(F.avg(weight).alias("mean_weight_squared"))
    out = out.withColumn("factor", factor)
    if mode == "raw":
        return out.withColumn("effective", F.lit(float(lambda0))).withColumn("lambda0", F.lit(float(lambda0)) / F.col("factor"))
    return out.withColumn("effective", F.lit(float(lambda0)) * F.col("factor")).withColumn("lambda0", F.lit(float(lambda0)))


def per_size_design(games: DataFrame, samples: int | Column, seed: str, *, pool: int = 64, lambda0: float = 1 / 16,
                    frame_weight: float = 1.0, mode: str = "normalized", name: str = "per_size") -> DataFrame:
    """Each size balanced on its own, one relabelling for the whole game."""
    schedule = systematic_schedule(games, samples, seed, INNER)

    def work(n, slices):
        weight = lambda0 * (1 - 1 / (n - 1)) if mode == "normalized" else lambda0
        balance = PairBalance(n, [weight] * len(slices), frame_weight, "size")
        chosen, _ = lock_step(n, [_sizes(r) for r in slices], [generator(seed, name, r["name"], r["size"]) for r in slices], pool, balance)
        for r, rows in zip(slices, chosen):
            yield name, r, _samples(r), _relabelled(rows, seed, "relabel", r["name"])

    return _run_together(_slices(schedule, ["size"]), pool, work)


def _sizes(r: dict) -> np.ndarray:
    return np.array([p["size"] for p in r["plan"]])


def _samples(r: dict) -> list[int]:
    return [p["sample"] for p in r["plan"]]


def coupled_design(games: DataFrame, samples: int | Column, seed: str, *, pool: int = 32, lambda0: float = 1.0,
                   mode: str = "normalized", name: str = "coupled") -> DataFrame:
    """One weighted operator for all sizes of a game."""
    schedule = systematic_schedule(games, samples, seed, INNER)

    def work(n, slices):
        sizes, weights = [_sizes(r) for r in slices], [lambda0] * len(slices)
        if mode == "normalized":
            weights = [lambda0 * ((1 - 1 / (n - 1)) * float(np.mean(s * (n - s)))) for s in sizes]
        chosen, _ = lock_step(n, sizes, [generator(seed, name, r["name"]) for r in slices], pool, PairBalance(n, weights, 1.0, "all"))
        for r, rows in zip(slices, chosen):
            yield name, r, _samples(r), _relabelled(rows, seed, "relabel", r["name"])

    return _run_together(_slices(schedule, []), pool, work)


def counted_slices(games: DataFrame, samples: Column, law: SizeLaw = INNER) -> DataFrame:
    """Slices (game, size) of the minimum-one allocation; samples are numbered size by size."""
    return minimum_one_counts(games, samples, law).withColumnRenamed("count", "samples_here")


def stratified_design(games: DataFrame, samples: Column, seed: str, *, pool: int = 32, lambda0: float = 1.0,
                      mode: str = "normalized", name: str = "stratified") -> DataFrame:
    """Minimum-one counts per size, balanced per size, relabelled per size."""

    def work(n, slices):
        weight = lambda0 * (1 - 1 / (n - 1)) if mode == "normalized" else lambda0
        balance = PairBalance(n, [weight] * len(slices), 1.0, "size")
        chosen, _ = lock_step(n, [_repeated(r) for r in slices], [generator(seed, name, r["name"], r["size"]) for r in slices], pool, balance)
        for r, rows in zip(slices, chosen):
            yield name, r, _numbered(r), _relabelled(rows, seed, "relabel", r["name"], r["size"])

    return _run_together(counted_slices(games, samples), pool, work)


def _repeated(r: dict) -> np.ndarray:
    return np.full(r["samples_here"], r["size"])


def _numbered(r: dict) -> np.ndarray:
    return r["size"] * 2**40 + np.arange(r["samples_here"])


def orbit_base_design(games: DataFrame, orbits: Column, seed: str, *, pool: int = 4, arms: tuple[str, ...] = ("orbit",)) -> DataFrame:
    """Orbit bases per size: the base whose signature cancels the sum best.

    arms may also ask for 'random_orbit', a control that shares pools and relabelling.
    """

    def work(n, slices):
        rngs = [generator(seed, "orbit", r["name"], r["size"]) for r in slices]
        chosen, control = lock_step(n, [_repeated(r) for r in slices], rngs, pool, ShiftBalance(n, len(slices), False), reuse=True)
        for arm in arms:
            for r, rows in zip(slices, chosen if arm == "orbit" else control):
                yield arm, r, _numbered(r), rows

    return _run_together(counted_slices(games, orbits), pool, work)


def coupled_orbit_bases(games: DataFrame, orbits: Column, seed: str, *, pool: int = 32) -> DataFrame:
    """Orbit sizes by systematic sampling, one weighted signature over all sizes of a game."""
    schedule = systematic_schedule(games, orbits, seed, INNER)

    def work(n, slices):
        rngs = [generator(seed, "coupled_orbit", r["name"]) for r in slices]
        chosen, _ = lock_step(n, [_sizes(r) for r in slices], rngs, pool, ShiftBalance(n, len(slices), True), reuse=True)
        for r, rows in zip(slices, chosen):
            yield "coupled_orbit", r, _samples(r), rows

    return _run_together(_slices(schedule, []), pool, work)


def orthogonal_orders(games: DataFrame, pairs: Column, seed: str) -> DataFrame:
    """Permutations from orthonormal zero-sum directions: blocks of at most n-1 directions.

    A block is QR of Gaussian rows beside the constant vector, argsorted row by row.
    Returns (game_id, n, pair, members) with players in permutation order.
    """
    width = F.greatest(F.col("n") - 1, F.lit(1)).cast("bigint")
    spec = games.withColumn("pairs", pairs.cast("bigint")).where("pairs > 0").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("pairs") / width) - 1)))
    spec = spec.withColumn("first", F.col("block") * width).withColumn(
        "rows", F.least(F.col("pairs") - F.col("first"), width).cast("int"))

    def work(r):
        n = int(r.n)
        if n == 1:
            yield r.game_id, "orthogonal", n, r.first, n, [0]
            return
        for i, row in enumerate(np.argsort(orthonormal_rows(int(r.rows), n, generator(seed, r.game_id, r.block)), axis=1)):
            yield r.game_id, "orthogonal", n, r.first + i, n, row.tolist()

    return _run(spec, work).select("game_id", "n", F.col("sample").alias("pair"), F.col("members").alias("players"))


def orthonormal_rows(count: int, n: int, rng) -> np.ndarray:
    """Random orthonormal rows that each sum to zero (count < n)."""
    rows = rng.standard_normal((count, n))
    left, _, right = np.linalg.svd(rows - rows.mean(axis=1, keepdims=True), full_matrices=False)
    return left @ right  # the orthonormal rows nearest to the centred ones


def expand_orbits(bases: DataFrame, seed: str, per_size: bool = True) -> DataFrame:
    """All n cyclic shifts of every base, relabelled by one permutation per (game[, size]).

    The relabelling is a hash-ordered permutation held in the row, so this needs no join.
    """
    from allotment.functions.hashing import order_key
    n = F.col("n")
    parts = [F.lit("relabel"), F.col("game_id")] + ([F.col("size")] if per_size else [])
    labels = F.transform(
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.struct(order_key(seed, *parts, p).alias("k"), p.alias("p")))),
        lambda e: e["p"])
    shifted = bases.withColumn("labels", labels).withColumn("shift", F.explode(F.sequence(F.lit(0), n - 1)))
    moved = F.transform("members", lambda m: F.col("labels")[(m + F.col("shift")) % n])
    return shifted.select("game_id", "design", "n", (F.col("sample") * n + F.col("shift")).alias("sample"), "size",
                          F.sort_array(moved).alias("members"))


def fill_pairs(partitions: DataFrame, seed: str) -> DataFrame:
    """S-Diff coverage fill: per (game, size), add coalitions until every ordered pair (i in, j out) occurs.

    Input and output rows are (game_id, n, size, members) with size <= n/2; the complement of every
    row belongs to the design as well, so a pair also counts at size n - s. Both are tracked.
    """

    def work(n, size, names, blocks):
        """The members of the rows that are added to slices alike in n and size, in order, per slice; slices share no state and no randomness."""
        added: list[list[np.ndarray]] = [[] for _ in names]
        counts = np.array([len(own) for own in blocks])
        rows = np.zeros((len(names), counts.max(), n))
        rows[np.repeat(np.arange(len(names)), counts * size), np.concatenate([np.repeat(np.arange(c), size) for c in counts]), np.concatenate([own.ravel() for own in blocks])] = 1.0
        there = (np.arange(counts.max()) < counts[:, None])[..., None]
        hit = np.matmul(rows.transpose(0, 2, 1), (1 - rows) * there) > 0
        missing = ~(hit | hit.transpose(0, 2, 1) if 2 * size == n else hit)
        missing[:, np.arange(n), np.arange(n)] = False
        rngs: dict[int, np.random.Generator] = {}
        while len(active := missing.any(axis=(1, 2)).nonzero()[0]):
            # One coalition for every player that misses another one: it joins, one of those stays out, chance fills up.
            at, players = missing[active].any(axis=2).nonzero()
            many = np.bincount(at, minlength=len(active))
            drawn = []
            for slot, count in zip(active.tolist(), many.tolist()):
                if slot not in rngs:
                    rngs[slot] = generator(seed, "fill", names[slot], size)
                drawn.append(rngs[slot].random((2, count, n)))
            keys, chance = np.concatenate(drawn, axis=1)
            slots, each = active[at], np.arange(len(players))
            keys[each, (chance * missing[slots, players]).argmax(axis=1)] = 2.0
            keys[each, players] = -1.0
            picks = np.sort(np.argsort(keys, axis=1)[:, :size], axis=1)
            inside = np.zeros((len(players), n), dtype=bool)
            np.put_along_axis(inside, picks, True, axis=1)
            turn = each - np.repeat(np.cumsum(many) - many, many)
            for k in range(many.max()):
                now = np.flatnonzero(turn == k)
                # Else those before it in this round have covered all of the player's pairs.
                now = now[missing[slots[now], players[now]].any(axis=1)]
                own = inside[now]
                still = missing[slots[now]] & ~(own[:, :, None] & ~own[:, None, :])
                missing[slots[now]] = still & ~(~own[:, :, None] & own[:, None, :]) if 2 * size == n else still
                for r in now.tolist():
                    added[slots[r]].append(picks[r])
        return added

    def task(batches):
        for batch in batches:
            games, names = batch.column("game_id").to_pylist(), batch.column("game_id").to_pandas().tolist()
            numbers, sizes = batch.column("n").to_pylist(), batch.column("size").to_pylist()
            blocks, many = batch.column("blocks"), batch.column("blocks").value_lengths().to_numpy()
            members, ends = blocks.flatten().flatten().to_numpy(), np.cumsum(many * np.array(sizes))
            own = [members[end - count * size:end].reshape(count, size) for end, count, size in zip(ends.tolist(), many.tolist(), sizes)]
            alike: dict[tuple[int, int], list[int]] = {}
            for k, shape in enumerate(zip(numbers, sizes)):
                alike.setdefault(shape, []).append(k)
            made = []
            for (n, size), ats in alike.items():
                per = max(1, CELLS // (4 * n * n))
                for part in (ats[first:first + per] for first in range(0, len(ats), per)):
                    for k, rows in zip(part, work(n, size, [names[k] for k in part], [own[k] for k in part])):
                        made += [(games[k], n, number, size, picks) for number, picks in enumerate(rows)]
            if made:
                game, n, added, size, picks = zip(*made)
                ends = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(game, pa.int64()), pa.array(["sdiff_fill"] * len(made)), pa.array(n, pa.int32()), pa.array(added, pa.int64()),
                     pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(picks), pa.int32()))],
                    ["game_id", "design", "n", "sample", "size", "members"])

    # At most ceil(n / size) blocks per row.
    spec = partitions.groupBy("game_id", "n", "size").agg(F.sort_array(F.collect_list("members")).alias("blocks"))
    return spec.repartition(shuffle_partitions()).mapInArrow(task, SCHEMA)


def sampled_rows(designs: DataFrame, players: DataFrame) -> DataFrame:
    """Long rows of array designs: every player of every coalition with `inside` and its attributes.

    Rows are multiplied after the only shuffle, by game: values and sums per game stay in the partition.
    """
    others = [c for c in players.columns if c not in ("game_id", "player")]
    few = designs.select("game_id", "design", "sample", "size", "members", F.col("n").alias("_n")).repartition(shuffle_partitions(), "game_id")
    cells = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda p: F.struct(
        F.array_contains("members", p).alias("inside"), F.get("own", p).alias("own")))
    rows = few.join(large(in_a_row(players, *others)), "game_id").select("game_id", "design", "sample", "size", F.inline(cells))
    return rows.where("own is not null").select("game_id", "own.player", "design", "sample", "size", "inside", *[f"own.{c}" for c in others],
                                                F.lit(0).cast("bigint").alias("block"))


def valued_rows(designs: DataFrame, players: DataFrame, utility) -> DataFrame:
    """(game_id, n, sample, size, members, value) of array designs: every coalition's utility, folded within its row.

    Coalitions are shuffled once, by game, and never become rows of players. Games without players are left out.
    """
    parts = players.withColumn("_own", utility.own())
    kind = parts.schema["_own"].dataType.simpleString()
    kind = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}.get(kind, kind)
    others = [c for c in players.columns if c not in ("game_id", "player", "n", "sample", "size", "members")]
    own = in_a_row(parts.withColumn("_own", F.col("_own").cast(kind)), "n", "_own", *others)
    few = designs.select("game_id", "sample", "size", "members").repartition(shuffle_partitions(), "game_id").join(large(own), "game_id")
    state = F.aggregate("members", F.lit(None).cast(kind), lambda acc, m: utility.merge(acc, F.get("own._own", m)))
    rows = few.select("game_id", "sample", "size", "members", state.alias("_state"), F.get("own", F.lit(0)).alias("_first"))
    rows = rows.select("game_id", "sample", "size", "members", "_state", "_first.n", *[f"_first.{c}" for c in others])
    return rows.select("game_id", "n", "sample", "size", "members", utility.value(F.col("_state")).alias("value"))
