"""Periodic runs of words, found with a dictionary of basic factors.

A basic factor is a stretch of 2^k words; equal ones of a document have equal names, and a name is a pair of names of
half the length. Where the next equal factor follows at a distance d of at most the length, for consecutive places, the
occurrences form arithmetic progressions with difference d, and the places together are all of a stretch with period d.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from allotment.llm.arrays import U64, WHITE, Words, constants, mix, pieces, range_hash

RUNS = "id {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: (ids, first word of each text and after the last, number of words of each text) -> the word that stands at each place
Rewrite = Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray]


def runs_of(names: np.ndarray, doc: np.ndarray, size: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs in sequences that follow each other, by start, then period.

    names: what stands at each place, different documents having different names; doc: sequence of each place; size:
    length of each sequence. A run is maximal, has smallest period q and max(least, exponent * q) places or more.

    For a factor length of at least q, an equal factor within a run can only follow at q (a nearer one would give a
    smaller period), and at the place before the run it can not follow at q. So places whose successors all stand at q
    are the run less its last q + factor places. The powers of two between q and 2q are short enough to fit exponent
    times, so no run is missed; what shows at several lengths is counted once. Memory is a few numbers per word.
    """
    n = len(names)
    at, key, width = np.arange(n), names.astype(np.int64), 1
    found = [np.zeros((0, 3), dtype=np.int64)]
    longest = size[doc] // exponent if n else size[:0]
    while len(at):
        order = np.argsort(key, kind="stable")
        equal = key[order[1:]] == key[order[:-1]]
        name = np.zeros(len(at), dtype=np.int64)
        name[order[1:]] = np.cumsum(~equal)
        gap = at[order[1:]] - at[order[:-1]]
        near = equal & (gap <= longest[at[order[1:]]])     # no period of a run is longer
        after = np.zeros(len(at), dtype=np.int64)
        after[order[:-1]] = np.where(near, gap, 0)
        proposed = np.flatnonzero((after > 0) & (after <= width))
        if len(proposed):
            period, place = after[proposed], at[proposed]
            opens = np.ones(len(place), dtype=bool)
            opens[1:] = (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(place)) - 1
            start, q = place[first], period[first]
            length = place[last] + q + width - start
            told = length >= np.maximum(least, exponent * q)
            found.append(np.stack([start, length, q], axis=1)[told])
        live = after > 0
        live[order[1:]] |= near
        known = np.full(n, -1, dtype=np.int64)
        known[at[live]] = name[live]
        at = at[live]
        half = at + width
        fits = half < n
        at, half = at[fits], half[fits]
        fits = (known[half] >= 0) & (doc[at] == doc[half])
        at, half = at[fits], half[fits]
        key, width = known[at] * (n + 1) + known[half], 2 * width
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def joined_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, per_text: np.ndarray) -> pa.Array:
    """A string per text of its words raw[start:end], a space between them; per_text says how many words each has."""
    size = end - start + 1
    out = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=out[1:])
    data = np.full(out[-1], 0x20, dtype=np.uint8)
    within = np.ones(out[-1], dtype=bool)
    within[out[1:] - 1] = False
    data[within] = raw[(np.repeat(start - out[:-1], size) + np.arange(out[-1]))[within]]
    bounds = out[np.concatenate([[0], np.cumsum(per_text)])]
    if len(data):                                       # the space behind a text's last word goes
        keep = np.ones(len(data), dtype=bool)
        keep[bounds[1:][per_text > 0] - 1] = False
        data = data[keep]
        bounds = bounds - np.concatenate([[0], np.cumsum(per_text > 0)])
    return pa.LargeStringArray.from_buffers(len(per_text), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))


def _runs(batches: Iterator[pa.RecordBatch], exponent: int, least: int, rewrite: Rewrite | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            words, ids = Words(piece.column("text"), WHITE), piece.column("id")
            n, count, doc = len(words.start), words.count, words.doc
            h = range_hash(constants("byte", 256)[words.raw], words.start, words.end)
            stands = np.arange(n) if rewrite is None else rewrite(ids, words.first, count)
            h = mix(h[stands] + doc.astype(np.uint64) * constants("run", 1))
            order = np.argsort(h, kind="stable")
            names = np.zeros(n, dtype=np.int64)
            names[order[1:]] = np.cumsum(h[order[1:]] != h[order[:-1]])
            start, length, period = runs_of(names, doc, count, exponent, least)
            covers = np.zeros(n + 1, dtype=np.int64)
            np.add.at(covers, start + period, 1)
            np.add.at(covers, start + length, -1)
            kept = np.flatnonzero(np.cumsum(covers)[:n] == 0)
            source, of = stands[kept], doc[start] if len(start) else np.zeros(0, dtype=np.int64)
            ends = np.searchsorted(of, np.arange(len(count) + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(v) for v in (start - words.first[of], length, period)], ["start", "length", "period"])
            text = joined_words(words.raw, words.start[source], words.end[source], np.bincount(doc[kept], minlength=len(count)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(count), pa.ListArray.from_arrays(pa.array(ends), rows), text.cast(pa.string())], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", exponent: int = 4, least: int = 6,
                  rewrite: Rewrite | None = None) -> DataFrame:
    """id, n_words, runs and collapsed text of every row of `docs`.

    Words are runs of anything but ASCII white space, told apart by 64-bit hashes. `runs` holds start, length and period of
    the maximal stretches whose smallest period q repeats `exponent` times or more (at least 3) over `least` words or more, by start,
    then period. `collapsed` has the words, one space between them, without those that any run contains after its first
    q words. `rewrite` may put other words of the same text in each place first.

    One pass, no shuffle: a task holds about a megabyte of text, or one longer text whole, at a time. Null, empty and
    white texts have no words, no runs and an empty collapsed text; repeated rows and null ids are rows of their own;
    other columns are ignored.
    """
    if exponent < 3:
        raise ValueError("successors tell the runs of three periods or more")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = rows.mapInArrow(partial(_runs, exponent=exponent, least=least, rewrite=rewrite), RUNS.format(id=rows.schema["id"].dataType.simpleString()))
    return found.withColumnRenamed("id", id_column)


def planted(ids: pa.Array, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A rewrite that gives one text of ten a periodic end, by h = crc32 of its decimal id; a null id plants nothing.

    With h % 10 = 0 and g = h // 10, from word a = g % n on, the p = 1 + (n - a) // (3 + g % 8) words there repeat.
    """
    stands = np.arange(first[-1])
    for i, (name, n) in enumerate(zip(ids.to_pylist(), count.tolist())):
        if name is None or not n:
            continue
        g, rest = divmod(zlib.crc32(str(name).encode()), 10)
        if not rest:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            stands[first[i] + a:first[i] + n] = first[i] + a + np.arange(n - a) % p
    return stands
