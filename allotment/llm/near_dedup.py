"""Near-duplicate documents: MinHash bands propose, odd sketches sort out, full shingle sets decide.

Odd sketch: every MinHash sample (number, value) is hashed to one of 4096 bits and flips it. Samples that two sets
share cancel out in the XOR of their sketches, so its population count tells how many samples differ, and is most
precise where similarities are high.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from allotment.llm.arrays import U64, WHITE, Words, constants, mix, pieces
from allotment.sources.shared import cut, erase

SHINGLE = 5
BANDS, ROWS, SAMPLES, BITS = 24, 3, 1024, 4096
NO_ID = (1 << 63) - 1


def shingles(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of each text.

    Words: runs of anything but ASCII white space, A-Z lower-cased. A text of one to four words has its whole sequence
    as its only shingle; an empty or null text has none.
    """
    words = Words(column, WHITE)
    h, factor = words.hashes(), constants("shingle", SHINGLE)
    n = len(h)
    whole = h[:0]
    if n >= SHINGLE:
        whole = mix(sum(h[j:n - SHINGLE + 1 + j] * factor[j] for j in range(SHINGLE)))
    out = []
    for first, count in zip(words.first[:-1].tolist(), words.count.tolist()):
        if count >= SHINGLE:
            out.append(np.unique(whole[first:first + count - SHINGLE + 1]))
        elif count:
            short = np.sum(h[first:first + count] * factor[:count], dtype=np.uint64, keepdims=True)
            out.append(mix(short + U64(count)))
        else:
            out.append(h[:0])
    return out


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES MinHash values (32 bits) of each set; sets must not be empty."""
    begin = np.zeros(len(sets), dtype=np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=begin[1:])
    flat = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    turn = (constants("turn", SAMPLES) >> U64(13)).astype(np.uint32)
    times = (constants("times", SAMPLES) >> U64(7)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(sets), SAMPLES), dtype=np.uint32)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat((flat ^ turn[i]) * times[i], begin)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    values = minima[:, :BANDS * ROWS].astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    keys = (values * constants("row", ROWS)).sum(axis=2, dtype=np.uint64) + constants("band", BANDS)
    return mix(mix(keys) + constants("band", BANDS)).view(np.int64)


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    parts = []
    for part in np.split(minima, range(512, len(minima), 512)):
        spots = (mix(part.astype(np.uint64) + constants("sample", SAMPLES)) % U64(BITS)).astype(np.int64)
        bits, rows = np.zeros((len(part), BITS), dtype=np.uint8), np.arange(len(part))
        for i in range(SAMPLES):
            bits[rows, spots[:, i]] ^= 1
        parts.append(np.packbits(bits, axis=1).view(np.int64))
    return np.concatenate(parts)


def digest(s: np.ndarray) -> int:
    """Name of a set: equal sets, equal names."""
    return int(mix(np.sum(s * (s >> U64(17) | U64(1)), dtype=np.uint64, keepdims=True) + U64(len(s))).view(np.int64)[0])


def lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), flat)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            sets = shingles(piece.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            row = np.zeros(len(sets), dtype=np.int64)
            row[full] = np.arange(len(full))
            bands, sketch = np.zeros((1, BANDS), np.int64), np.zeros((1, BITS // 64), np.int64)
            if full:
                minima = samples([sets[i] for i in full])
                bands, sketch = band_keys(minima), odd_sketches(minima)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([digest(s) if len(s) else None for s in sets], pa.int64()),
                 lists(bands[row]), lists(sketch[row])], ["id", "row", "n_shingles", "cid", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            sets = shingles(piece.column("text"))
            ends = np.zeros(len(sets) + 1, dtype=np.int32)
            np.cumsum([len(s) for s in sets], out=ends[1:])
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [piece.column("cid"), pa.array([digest(s) if len(s) else None for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cid", "found", "members"])


def differing_bits(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0))


def most_bits(similarity: float) -> float:
    """Bits that differ on average at this similarity."""
    return BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / BITS))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected graph of longs (a, b); root is the smallest node reachable.

    Large-star and small-star steps in turn: every node's larger, then smaller neighbours are linked with the smallest
    one. Steps go on until the links stay the same; each is a table in the shared folder, so a lost executor costs no
    more than its own part of one step.
    """
    def state(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(least, "u")
        if large:
            moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v")))
        return moved.filter("u != v").distinct()

    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    before = state(links)
    while before[0]:
        earlier, links = links, cut(star(star(links, True), False), "links")
        erase(earlier)
        after = state(links)
        if after == before:
            break
        before = after
    nodes = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text",
                    loosest: float = 0.665) -> DataFrame:
    """Every row of `docs` with its set size and the component of similar documents it belongs to.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| on their sets of 5-word shingles; copies of a
    set are one class, whatever their number. Returns id, n_shingles, component_id (the smallest id that links reach,
    itself included), kept and row (xxhash64 of the text).

    1. One pass over the texts gives set size, set name, band keys and odd sketch of each row.
    2. A bucket holds the classes with one band key. Every class is compared with the hub of its buckets whose sketch is
       nearest: as many pairs as classes, however large a bucket is. A bucket's hub is the class with the most
       companions over all its buckets, as an original has among its edited copies.
    3. Links found so far make components. What is left are pairs of one bucket in different components: all of them
       are compared by sketch, once, in the first bucket they share (within the join, which Spark can split) and, if
       near enough, by full sets.

    `loosest` is the similarity below which a sketch ends a comparison; it lies more than five standard deviations (of 1024
    samples in 4096 bits) below the limit, so that of pairs at the very limit fewer than one in ten million are lost to it (the
    bands lose some 2 in a million), and full sets decide. Nulls, empty and white texts have no shingle and are linked with nothing; a
    null id is larger than every other id, and its component_id is null if no other id is reached. Rows with the same
    id and text share everything; rows with the same id and different texts are documents of their own. Other columns
    are ignored. Set names and shingle hashes have 64 bits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_column), F.lit(NO_ID)).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = cut(rows.withColumn("row", F.xxhash64("text")).mapInArrow(_sign, "id long, row long, n_shingles long, cid long, bands array<long>, sketch array<long>"), "signed")
    classes = cut(signed.filter("cid is not null").groupBy("cid").agg(
        F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")

    spread = classes.select(F.explode("bands").alias("band"), "cid")
    shared = cut(spread.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "shared")  # written, so that the join's hot keys can be split
    members = cut(spread.join(shared, "band"), "members")
    fame = members.groupBy("cid").agg(F.sum("n").alias("fame"))
    ranked = members.join(fame, "cid")
    hubs = cut(ranked.groupBy("band").agg(F.max(F.struct("fame", "cid")).alias("top")).select("band", F.col("top.cid").alias("hub")), "hubs")

    sketches = classes.select("cid", "sketch")
    done = [shared, members, hubs]
    limit = most_bits(loosest)

    def near(pairs: DataFrame) -> DataFrame:
        left = sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("sketch_a"))
        right = sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("sketch_b"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", differing_bits("sketch_a", "sketch_b").alias("bits")).filter(F.col("bits") <= limit)

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough; texts are read again for the classes in question."""
        asked = pairs.select(F.col("a").alias("cid")).distinct().unionByName(pairs.select(F.col("b").alias("cid")).distinct()).distinct()
        wanted = classes.join(asked, "cid").select(F.col("rep").alias("id"), "cid")
        sets = rows.join(wanted, "id").select("cid", "text").mapInArrow(_sets, "cid long, found long, members array<long>")
        sets = cut(sets.filter("cid = found").select("cid", "members").dropDuplicates(["cid"]), "sets")
        done.append(sets)
        a = sets.select(F.col("cid").alias("a"), F.col("members").alias("set_a"))
        b = sets.select(F.col("cid").alias("b"), F.col("members").alias("set_b"))
        common = F.size(F.array_intersect("set_a", "set_b"))
        both = F.size("set_a") + F.size("set_b") - F.col("common")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b", common.alias("common")).filter(
            F.col("common") * 100 >= both * percent).select("a", "b")

    stars = members.join(hubs, "band").filter("cid != hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    first = cut(near(stars).groupBy("b").agg(F.min(F.struct("bits", "a")).alias("best")).select("best.a", "b"), "pairs")
    links = cut(linked(first), "links")
    roots = cut(components(links), "roots")

    placed = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "band", "cid", F.coalesce("root", "cid").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most").select("band")
    mixed = cut(mixed, "mixed")
    open_rows = cut(placed.join(mixed, "band").join(classes.select("cid", "bands", "sketch"), "cid"), "open")
    done += [first, mixed, open_rows]
    left, right = (open_rows.select([F.col(c).alias(f"{c}_{side}") for c in open_rows.columns]) for side in "ab")
    meet = F.zip_with("bands_a", "bands_b", lambda x, y: x == y)
    across = left.join(right, (F.col("band_a") == F.col("band_b")) & (F.col("cid_a") < F.col("cid_b")) & (F.col("root_a") != F.col("root_b"))
                       & (differing_bits("sketch_a", "sketch_b") <= limit)
                       & (F.array_position(meet, True) == F.array_position("bands_a", F.col("band_a"))))
    across = across.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = cut(across.join(tried, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        links = cut(links.unionByName(linked(rest)), "links")
        roots = cut(components(links), "roots")

    erase(*done, rest)
    named = classes.select("cid", "rep").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "cid", "rep", F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = named.join(least, "root").select("cid", "component")
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return signed.select("id", "row", "n_shingles", "cid").join(of_class, "cid", "left").withColumn(
        "component", F.coalesce("component", "id")).select(
        back("id").alias(id_column), "n_shingles", back("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"), "row")


def deduplicated(docs: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with one document of each component: its smallest id. Repeated rows of that id and text stay once."""
    found = near_duplicates(docs, percent, id_column, text_column)
    number = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("__id")
    keep = found.filter("kept").select(number, F.col("row").alias("__row")).distinct()
    rows = docs.select("*", number, F.xxhash64(text_column).alias("__row"))
    return rows.join(keep, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"]).select(*docs.columns)  # one shuffle of texts for both
