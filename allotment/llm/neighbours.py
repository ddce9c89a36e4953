"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample; every row goes to the list of its nearest centroid and, near a boundary, to
those almost as near. A query walks a graph of centroids in memory and reads the lists whose centroids are not much
farther than the nearest one; distances to the vectors themselves are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from allotment.llm.sampling import smallest
from allotment.sources.shared import cut

#: Rows of the sample that centroids are fitted on (fewer for long vectors), and rows of a list on average.
SAMPLE, SAMPLE_NUMBERS, LIST_ROWS = 20_000, 8_000_000, 256
#: A row is also in lists whose centroid is at most this much farther than the nearest, up to COPIES lists.
BOUNDARY, COPIES = 1.03, 4
#: A query reads lists at most this much farther than the nearest, of those a walk with this beam has found.
RATIO, BEAM, LEAST_LISTS, GRAPH_LINKS = 1.15, 96, 12, 12
#: Rows of one list that one task looks at together.
SHARD_ROWS = 8192


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """Halve the largest part along the line between two means until there are enough parts, then polish: rows move to
    their nearest centroid, which is charged for being over-full."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(sample))]
    while len(parts) < lists:
        i = max(range(len(parts)), key=lambda k: len(parts[k]))
        part = parts.pop(i)
        if len(part) < 2:
            parts.append(part)
            break
        x = sample[part]
        a, b = x[rng.integers(len(x))], x[rng.integers(len(x))]
        for _ in range(3):
            near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = x[near].mean(0), x[~near].mean(0)
        order = np.argsort(x @ (b - a), kind="stable")
        parts += [part[order[:len(order) // 2]], part[order[len(order) // 2:]]]
    centroids = np.array([sample[p].mean(0) for p in parts])
    wanted = len(sample) / len(centroids)
    charge = np.zeros(len(centroids))
    for _ in range(rounds):
        distance = squared(sample, centroids)
        scale = distance.min(1).mean()
        owner = (distance + charge).argmin(1)
        sizes = np.bincount(owner, minlength=len(centroids))
        charge = np.maximum(0, charge + 0.1 * scale * (sizes / wanted - 1))
        for c in np.flatnonzero(sizes):
            centroids[c] = sample[owner == c].mean(0)
    return centroids


@dataclass
class Graph:
    """Centroids, each linked with its nearest ones both ways and with some at random, so that every one can be reached."""

    centroids: np.ndarray
    links: np.ndarray
    entry: int

    @classmethod
    def build(cls, centroids: np.ndarray) -> Graph:
        n = len(centroids)
        k = min(GRAPH_LINKS, n - 1)
        near = np.zeros((n, k), dtype=np.int64)
        for i in range(0, n, 1024):
            d = squared(centroids[i:i + 1024], centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i:i + 1024] = np.argsort(d, axis=1, kind="stable")[:, :k]
        both = [set(row) for row in near.tolist()]
        for i, row in enumerate(near.tolist()):
            for j in row[:k // 2 + 1]:
                both[j].add(i)
            both[i].add((i + 1) % n)
        width = max(map(len, both))
        links = np.array([sorted(s) + [i] * (width - len(s)) for i, s in enumerate(both)], dtype=np.int64)
        return cls(centroids, links, int(squared(centroids.mean(0, keepdims=True), centroids).argmin()))

    def nearest(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks for all queries together: centroids and distances, nearest first (-1 where none is left)."""
        n, width = len(queries), min(beam, len(self.centroids))
        seen = np.zeros((n, len(self.centroids)), dtype=bool)
        rows = np.arange(n)
        found, done = np.full((n, width), -1), np.zeros((n, width), bool)
        distance = np.full((n, width), np.inf)
        found[:, 0] = self.entry
        distance[:, 0] = np.sqrt(((queries - self.centroids[self.entry]) ** 2).sum(1))
        seen[:, self.entry] = True
        while True:
            waiting = np.where(done | (found < 0), np.inf, distance)
            pick = waiting.argmin(1)
            live = np.isfinite(waiting[rows, pick])
            if not live.any():
                return found, distance
            at = rows[live]
            done[at, pick[live]] = True
            around = self.links[found[at, pick[live]]]
            fresh = ~seen[at[:, None], around]
            seen[at[:, None], around] = True
            d = np.sqrt(((queries[at][:, None, :] - self.centroids[around]) ** 2).sum(2))
            d[~fresh] = np.inf
            all_d = np.concatenate([distance[at], d], axis=1)
            all_f = np.concatenate([found[at], np.where(fresh, around, -1)], axis=1)
            all_n = np.concatenate([done[at], np.zeros(d.shape, bool)], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            distance[at], found[at], done[at] = (np.take_along_axis(x, order, 1) for x in (all_d, all_f, all_n))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _place(centroids: np.ndarray):
    """Rows with the list each belongs to, boundary rows several times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                piece = batch.slice(i, 2048)
                d = np.sqrt(squared(matrix(piece.column("vector")), centroids))
                k = min(COPIES, d.shape[1])
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                far = np.take_along_axis(d, near, 1)
                chosen = far <= BOUNDARY * far.min(1, keepdims=True)
                row, at = np.nonzero(chosen)
                taken = piece.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(near[row, at].astype(np.int32)), taken.column("vec_id"), taken.column("vector")], ["list", "vec_id", "vector"])
    return run


def _route(graph: Graph, sizes: np.ndarray, ratio: float):
    """Queries with each list they read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                found, d = graph.nearest(matrix(piece.column("vector")))
                held = np.where(found >= 0, sizes[found], 0)
                before = np.cumsum(held, axis=1) - held
                chosen = (found >= 0) & ((d <= ratio * d[:, :1]) | (np.arange(d.shape[1]) < LEAST_LISTS) | (before < 64))
                row, at = np.nonzero(chosen)
                taken = piece.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(found[row, at].astype(np.int32)), taken.column("vec_id"), taken.column("vector")], ["list", "query_id", "query"])
    return run


def _scan(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The k nearest ids of one shard for each query that reads its list; an id counts with its nearest row."""
        out = []
        if len(queries) and len(rows):
            ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(np.float64)
            repeated = len(np.unique(ids)) < len(ids)
            for query_id, query in zip(queries["query_id"], queries["query"]):
                other = ids != query_id
                d = vectors - np.asarray(query, dtype=np.float64)
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                d[~other] = np.inf
                best = np.lexsort((ids, d))
                if repeated:
                    best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
                best = best[:k]
                best = best[other[best]]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[best], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    return run


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part: an id, no null or non-finite component, not all zero, and as
    many components as most rows have."""
    v = F.col(vector_column).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (common.n if common else 0))


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding", ratio: float = RATIO) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance in double precision) of the k nearest rows found for each row
    whose id is divisible by `every`.

    All rows are indexed and no list is cut short: long ones are read by several tasks, a shard each. Ties go to
    smaller ids; rows with a query's id are its own. Rows with the same id and different vectors are rows of their
    own, of which a query keeps the nearest. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    schema = "query_id long, rank int, vec_id long, score double"
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).first()
    if not facts.n:
        return spark.createDataFrame([], schema)
    bound = max(1, min(SAMPLE, SAMPLE_NUMBERS // facts.size))
    sample = matrix(smallest(rows.withColumn("place", F.xxhash64(F.lit("sample"), "vec_id", "vector")), "place", bound).select("vector").toArrow().column("vector"))
    lists = max(1, min(facts.n // LIST_ROWS, len(sample) // 4))
    centroids = balanced_centroids(sample, lists)
    placed = cut(rows.mapInArrow(_place(centroids), "list int, vec_id long, vector array<double>"), "lists")
    counts = placed.groupBy("list").count()
    sizes = np.zeros(len(centroids), dtype=np.int64)
    for r in counts.collect():  # one number a list
        sizes[r["list"]] = r["count"]
    shards = F.element_at(F.lit([max(1, -(-int(s) // SHARD_ROWS)) for s in sizes]), F.col("list") + 1)
    queries = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"])
    reads = queries.mapInArrow(_route(Graph.build(centroids), sizes, ratio), "list int, query_id long, query array<double>")
    reads = reads.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    parts = placed.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), shards).cast("int"))
    found = reads.groupBy("list", "shard").cogroup(parts.groupBy("list", "shard")).applyInPandas(_scan(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
