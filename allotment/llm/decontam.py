"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from allotment.llm.arrays import NOT_WORD, Words, pieces
from allotment.sources.shared import cut

WINDOW = 10
#: Bytes of item text that go into one automaton; more items make further scans, none is left out.
AUTOMATON_BYTES = 256 << 10
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"

_automata: dict[int, tuple] = {}


def _spaced(words: Words) -> tuple[str, np.ndarray]:
    """All texts as ` w1 w2 ... ` with a zero byte after each text, one character a byte; and where each word ends there."""
    size = words.end - words.start
    ends = np.cumsum(size + 1) + words.doc * 2
    total = int(size.sum()) + len(size) + 2 * len(words.count)
    out = np.full(total, 0x20, dtype=np.uint8)
    # a text ends with a space and a zero byte
    after = np.zeros(len(words.count) + 1, dtype=np.int64)
    np.cumsum(size + 1, out=(running := np.zeros(len(size) + 1, dtype=np.int64))[1:])
    after = running[words.first[1:]] + 2 * np.arange(1, len(words.count) + 1)
    out[after - 1] = 0
    inside = np.arange(int(size.sum())) + np.repeat(ends - np.cumsum(size), size)
    source = np.arange(int(size.sum())) + np.repeat(words.start - (np.cumsum(size) - size), size)
    out[inside] = words.data[source]
    return out.tobytes().decode("latin-1"), ends


def windows(items: list[tuple[str | None, str | None]]) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Windows ` w1 ... w10 ` of benchmark items (id as text, text): their number of words and the ids they stand for."""
    words = Words(pa.array([t for _, t in items], pa.string()), NOT_WORD)
    parts = [words.data[s:e].tobytes().decode("latin-1") for s, e in zip(words.start.tolist(), words.end.tolist())]
    found: dict[str, tuple[int, set]] = {}
    for (item, _), first, count in zip(items, words.first.tolist(), words.count.tolist()):
        for i in range(first, first + max(1, count - WINDOW + 1) if count else first):
            some = parts[i:min(i + WINDOW, first + count)]
            entry = found.setdefault(f" {' '.join(some)} ", (len(some), set()))
            if item is not None:
                entry[1].add(item)
    return {k: (n, tuple(sorted(ids))) for k, (n, ids) in found.items()}


def _automaton(items: list) -> tuple:
    """Built once in a Python worker."""
    key = hash(tuple(items))
    if key not in _automata:
        _automata.clear()
        built = ahocorasick.Automaton()
        for text, value in windows(items).items():
            built.add_word(text, value)
        built.make_automaton()
        _automata[key] = (built, len(built))
    return _automata[key]


def scan(items: list, column: str = "text"):
    """A function on Arrow batches with a column of texts that finds every window in every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, size = _automaton(items)
        for batch in batches:
            for piece in pieces(batch, column):
                words = Words(piece.column(column), NOT_WORD)
                text, ends = _spaced(words)
                hit = np.zeros(len(words.start) + 1, dtype=np.int64)
                ids: dict[int, set] = {}
                for end, (count, names) in (automaton.iter(text) if size else ()):
                    last = int(np.searchsorted(ends, end))
                    last -= last == len(ends) or ends[last] > end  # the word before the closing space
                    hit[last - count + 1] += 1
                    hit[last + 1] -= 1
                    ids.setdefault(int(words.doc[last]), set()).update(names)
                covered = np.cumsum(hit[:-1]) > 0
                total = np.zeros(len(covered) + 1, dtype=np.int64)
                np.cumsum(covered, out=total[1:])
                points = words.code_points() if ids else None
                spans = []
                for i in range(piece.num_rows):
                    spans.append([])
                    if i in ids:
                        first, last = words.first[i], words.first[i + 1]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[first:last], [0]]).astype(np.int8)))
                        zero = points[words.bounds[i]]
                        spans[-1] = [{"start": int(points[words.start[first + a]] - zero), "end": int(points[words.end[first + b - 1]] - zero)}
                                     for a, b in zip(edge[::2], edge[1::2])]
                others = [c for c in piece.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*map(piece.column, others), pa.array(words.count.astype(np.int64)),
                     pa.array(total[words.first[1:]] - total[words.first[:-1]]),
                     pa.array([sorted(ids.get(i, ())) for i in range(piece.num_rows)], pa.list_(pa.string())),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    [*others, "n_words", "n_hit", "items", "spans"])
    return run


def item_groups(items: DataFrame, id_column: str, text_column: str) -> list[list]:
    """The items on the driver, in groups for one automaton each; a benchmark is a list of questions of known size."""
    groups, size = [[]], 0
    for item, text in items.select(F.col(id_column).cast("string"), text_column).toLocalIterator():
        if size and size + len(text or "") > AUTOMATON_BYTES:
            groups.append([])
            size = 0
        groups[-1].append((item, text))
        size += len(text or "")
    return groups


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text_column: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns `keep` (by default doc_id) of every row of `docs` with n_words, n_hit, items (ids found) and spans hit
    (code points of the original text).

    Words are runs of ASCII digits, ASCII letters (A-Z lower-cased) and anything beyond ASCII. A window is 10
    consecutive words of an item, or all of a shorter item. A document word inside any window's occurrence is hit.
    Text is scanned once by one automaton. Only where the items have more than AUTOMATON_BYTES of text, there is one
    scan for each group of items; n_hit then counts the union of their spans.

    Null and empty texts have no words; items without words have no window; an item without id marks words but is not
    listed; items with one id count once; repeated rows of `docs` are each judged. Other columns are ignored.
    """
    keep = keep or ["doc_id"]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    carried = ", ".join(f"k{i} {kind}" for i, kind in enumerate(kinds))
    texts = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_column).alias("text"))
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)] + ["n_words", "n_hit", "items", "spans"]
    groups = item_groups(items, item_id, item_text)
    if len(groups) == 1:
        own = f"k{keep.index(text_column)}" if text_column in keep else "text"  # a text goes to Python once
        return (texts.drop("text") if text_column in keep else texts).mapInArrow(scan(groups[0], own), f"{carried}, {FOUND}").select(*names)
    texts = cut(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    found = [texts.select("row", "text").mapInArrow(scan(group), f"row long, {FOUND}") for group in groups]
    merged = reduce(DataFrame.unionByName, found).groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"))
    return texts.join(merged, "row").drop("row").mapInArrow(union_spans, f"{carried}, {FOUND}").select(*names)


def union_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins overlapping spans of one text and counts the words inside."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            words = Words(piece.column("text"), NOT_WORD)
            points = words.code_points()
            hits, spans = [], []
            for i, found in enumerate(piece.column("spans").to_pylist()):
                own = slice(words.first[i], words.first[i + 1])
                zero = points[words.bounds[i]]
                starts, ends = points[words.start[own]] - zero, points[words.end[own]] - zero
                hit = np.zeros(len(starts), dtype=bool)
                for s in found:
                    hit[np.searchsorted(starts, s["start"]):np.searchsorted(starts, s["end"])] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
                hits.append(int(hit.sum()))
                spans.append([{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(edge[::2], edge[1::2])])
            others = [c for c in piece.schema.names if c not in ("text", "items", "spans")]
            yield pa.RecordBatch.from_arrays(
                [*map(piece.column, others), pa.array(words.count.astype(np.int64)), pa.array(hits, pa.int64()), piece.column("items"),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                [*others, "n_words", "n_hit", "items", "spans"])
