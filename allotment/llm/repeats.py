"""Repeated lines, sentences and passages across documents: global digests of normalised units, the earliest one stays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from allotment.llm.arrays import U64, WHITE, Words, byte_table, constants, mix, pieces, range_hash, wide
from allotment.sources.shared import cut

#: A unit with fewer words is told by its neighbours in the line as well, so chance repeats of short ones stay.
MIN_WORDS = 8
#: A whole line may be shorter.
MIN_LINE_WORDS = 4
SENTENCE_END = byte_table(b".!?")
OTHER_ENDS = np.array([ord(c) for c in "。！．？｡।॥؟۔።။។"])
#: Scripts without spaces (Thai, Lao, Burmese, Khmer, kana, Han and their full-width signs): every code point is a word of
#: its own, and WORD of them count as one. A whole line of LONG_LINE code points needs no number of words.
UNSPACED = np.array([(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3000, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
                     (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x3FFFF)]) + [0, 1]
WORD, LONG_LINE = 5, 40
#: Passages are told by runs of GRAM words; of every REACH runs that follow each other, the one with the least hash is an edge.
GRAM, REACH = 8, 12
#: A passage of fewer words is left where it is.
LEAST_WORDS = 25
#: 64-bit words of the bitmap that keeps digests that surely occur once out of the second pass (16 MB, whatever the input).
BITMAP = 1 << 21
LAST = (1 << 63) - 1
UNITS = "id long, row long, d1 long, d2 long, start int, end int, first int, after int, again boolean"
RUNS = "id long, row long, start int, end int, words int, first_id long, copies long"


def unspaced(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and last byte + 1 of the code points of scripts without spaces."""
    at, size, code = wide(raw)
    own = np.searchsorted(UNSPACED.ravel(), code, "right") % 2 == 1
    return at[own], (at + size)[own]


def sentence_ends(words: Words) -> np.ndarray:
    """Bytes that end a sentence."""
    ends = SENTENCE_END[words.data]
    at, size, code = wide(words.raw)
    ends[(at + size - 1)[np.isin(code, OTHER_ENDS)]] = True
    return ends


def sizes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over words, in parts of a word: of characters where a script has no spaces, and of what white space parts."""
    n = len(words.start)
    by_characters, by_spaces = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    alone = np.zeros(len(words.raw) + 1, dtype=bool)
    alone[unspaced(words.raw)[0]] = True
    np.cumsum(np.where(alone[words.start], 1, WORD), out=by_characters[1:])
    apart = np.ones(n, dtype=bool)
    apart[1:] = (words.start[1:] > words.end[:-1]) | (words.doc[1:] != words.doc[:-1])
    np.cumsum(apart * WORD, out=by_spaces[1:])
    return by_characters, by_spaces


def units(words: Words) -> dict[str, np.ndarray]:
    """Sentences within lines: first and last word of each, and the words [since, until) its digest is made of."""
    n = len(words.start)
    lines = np.zeros(len(words.raw) + 1, dtype=np.int64)
    np.cumsum(words.raw == 0x0A, out=lines[1:])
    line = lines[words.start] + words.doc  # a new document is a new line too
    new_line = np.ones(n, dtype=bool)
    new_line[1:] = line[1:] != line[:-1]
    new = new_line.copy()
    new[1:] |= sentence_ends(words)[words.end[:-1] - 1]
    first = np.flatnonzero(new)
    after = np.append(first[1:], n)
    count = len(first)
    opens = np.flatnonzero(new_line[first])                         # units that open a line
    in_line = np.cumsum(new_line[first]) - 1
    least, most = opens[in_line], np.append(opens[1:], count)[in_line] - 1
    a, b = np.arange(count), np.arange(count)
    sums = sizes(words)
    size = lambda a, b: np.maximum(*(s[after[b]] - s[first[a]] for s in sums))
    while (short := (size(a, b) < MIN_WORDS * WORD) & (a > least)).any():
        a = a - short
    while (short := (size(a, b) < MIN_WORDS * WORD) & (b < most)).any():
        b = b + short
    points = words.code_points()
    long = points[words.end[after[b] - 1]] - points[words.start[first[a]]] >= LONG_LINE
    whole = (a == least) & (b == most) & ((size(a, b) >= MIN_LINE_WORDS * WORD) | long)
    told = (size(a, b) >= MIN_WORDS * WORD) | whole
    return {k: v[told] for k, v in {"first": first, "after": after, "since": first[a], "until": after[b]}.items()}


def passages(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last of the stretches of text from one edge to the end of the next edge's run.

    Edges depend on the words of REACH runs alone, so equal passages have equal edges wherever they stand, but for less
    than REACH words at both ends.
    """
    n = len(h)
    none = np.zeros(0, dtype=np.int64)
    size, _ = sizes(words)
    until = np.searchsorted(size, size[:-1] + GRAM * WORD)
    until = until[until <= n]
    if len(until) < REACH:
        return none, none
    run = range_hash(h, np.arange(len(until)), until)
    seen = np.arange(len(run) - REACH + 1)
    seen = seen[words.doc[seen] == words.doc[until[seen + REACH - 1] - 1]]
    edge = np.unique(seen + np.lib.stride_tricks.sliding_window_view(run, REACH)[seen].argmin(axis=1))
    same = words.doc[edge[1:]] == words.doc[edge[:-1]]
    return edge[:-1][same], until[edge[1:][same]]


def bitmap(repeats: DataFrame) -> np.ndarray:
    """A bit for every d1 of `repeats`. Of other digests a part has its bit set too, all the more the more repeats there are."""
    at, bit = F.col("d1").bitwiseAND(F.lit(BITMAP - 1)), F.shiftrightunsigned("d1", 21).bitwiseAND(F.lit(63)).cast("int")
    found = repeats.groupBy(at.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    words = np.zeros(BITMAP, dtype=np.int64)
    words[found["at"].to_numpy()] = found["bits"].to_numpy()
    return words.view(np.uint64)


def may_repeat(words: np.ndarray, d1: np.ndarray) -> np.ndarray:
    return words[(d1 & U64(BITMAP - 1)).astype(np.int64)] >> ((d1 >> U64(21)) & U64(63)) & U64(1) > 0


def _units(batches: Iterator[pa.RecordBatch], inner: bool = False, wanted: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            words = Words(piece.column("text"), WHITE, unspaced)
            if not len(words.start):
                continue
            u, h = units(words), words.hashes()
            place = ((u["first"] - u["since"]) * 65536 + (u["after"] - u["first"])).astype(np.uint64)
            if inner:
                first, after = passages(words, h)
                u = {k: np.concatenate([u[k], v]) for k, v in {"first": first, "after": after, "since": first, "until": after}.items()}
                place = np.concatenate([place, np.full(len(first), constants("passage", 1)[0])])
            d1 = mix(range_hash(h, u["since"], u["until"]) + place)
            d2 = mix(range_hash(mix(h ^ constants("second", 1)), u["since"], u["until"]) + place)
            doc = words.doc[u["first"]]
            order = np.lexsort((d1, doc))                          # stable, so the earliest of equals comes first
            opens = np.ones(len(order), dtype=bool)
            opens[1:] = (d1[order[1:]] != d1[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
            kept = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))] if len(order) else order
            again = np.zeros(len(order), dtype=bool)
            again[order] = u["first"][order] >= u["after"][kept]   # what overlaps the one that stays is no repeat of it
            points = words.code_points()
            if wanted is not None:
                asked = may_repeat(wanted.value, d1)
                d1, d2, doc, again, u = d1[asked], d2[asked], doc[asked], again[asked], {k: v[asked] for k, v in u.items()}
            zero = points[words.bounds[doc]]
            yield pa.RecordBatch.from_arrays(
                [piece.column("id").take(pa.array(doc)), piece.column("row").take(pa.array(doc)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                 pa.array((points[words.start[u["first"]]] - zero).astype(np.int32)), pa.array((points[words.end[u["after"] - 1]] - zero).astype(np.int32)),
                 pa.array((u["first"] - words.first[doc]).astype(np.int32)), pa.array((u["after"] - words.first[doc]).astype(np.int32)), pa.array(again)],
                [part.split()[0] for part in UNITS.split(", ")])


def repeated_units(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The units to remove: every occurrence but the earliest of a line or sentence that occurs more than once.

    A unit is a sentence of a line, ends told by . ! ?, their likes in other scripts, or the line. Its digest (128 bits) is taken of its words with
    A-Z lower-cased and white space ignored; a unit of fewer than MIN_WORDS words is told together with the sentences
    before it in the line, then with those behind, so that only the repeat of all of them counts; whole lines may be
    as short as MIN_LINE_WORDS, or fewer words of LONG_LINE code points. In scripts without spaces WORD characters count as
    a word, though `words` counts each. Rank is the id, then the place in the text. Returns id, row (xxhash64 of the text),
    start and end (code points of the original), words, first_id (the document that keeps it) and copies.

    Digests are counted before they are joined, a bitmap of fixed size keeps most single ones out of the join, and its hot
    keys can be split. Null, empty and white texts have
    no units; null ids come last; rows of one id are one document, so its repeated rows keep what the document keeps
    (`again` tells repeats within a row). Other columns are ignored.
    """
    known = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return _repeated(docs, id_column, text_column, False).select(
        known("id").alias(id_column), "row", "start", "end", (F.col("after") - F.col("first")).alias("words"), known("first_id"), "copies")


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Repeated passages of at least `least` words, whole: repeated units and stretches of a text that touch or overlap are
    one passage.

    Columns are those of repeated_units; first_id is the earliest document that keeps a part, copies the least number of occurrences
    of a part. Where nothing around it repeats, a line or sentence of fewer words stays; least = 1 gives all.

    Stretches begin and end anywhere, also inside sentences. They are cut where the words themselves say so (`passages`) and have GRAM + 1 to GRAM + REACH words, across lines
    too (in scripts without spaces GRAM * WORD characters in place of GRAM words, REACH characters in place of REACH). Of a run of at least 2 * REACH + GRAM - 1 words that an earlier document or place has, all but less than REACH
    words at either end are found, whatever stands around it.
    """
    spans = F.struct("start", "end", "first", "after", "first_id", "copies")
    per_row = _repeated(docs, id_column, text_column, True).groupBy("id", "row").agg(F.collect_set(spans).alias("spans"))
    known = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return per_row.mapInArrow(partial(_joined, least=least), RUNS).select(
        known("id").alias(id_column), "row", "start", "end", "words", known("first_id"), "copies")


def _joined(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Spans of a text that overlap or follow each other without a word between, as one."""
    for batch in batches:
        lists = batch.column("spans")
        own = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        start, end, first, after, first_id, copies = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        order = np.lexsort((first, own))
        own, first = own[order], first[order].astype(np.int64)
        reached = np.maximum.accumulate((own << 32) + after[order])  # the last word so far; a later text begins beyond all of it
        opens = np.ones(len(order), dtype=bool)
        opens[1:] = (own[1:] << 32) + first[1:] > reached[:-1]
        at = np.flatnonzero(opens)
        words = reached[np.append(at[1:], len(order)) - 1] - (own[at] << 32) - first[at]
        told = words >= least
        at_row = pa.array(own[at][told])
        whole = lambda f, x: pa.array(f.reduceat(x[order], at)[told])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(at_row), batch.column("row").take(at_row), whole(np.minimum, start), whole(np.maximum, end), pa.array(words[told].astype(np.int32)),
             whole(np.minimum, first_id), whole(np.minimum, copies)], [c.split()[0] for c in RUNS.split(", ")])


def _repeated(docs: DataFrame, id_column: str, text_column: str, inner: bool) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("id"),
                       F.xxhash64(text_column).alias("row"), F.col(text_column).alias("text"))
    found = rows.mapInArrow(partial(_units, inner=inner), UNITS)
    repeats = found.groupBy("d1", "d2").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    repeats = cut(repeats, "repeats")  # written, so that the join's hot keys can be split
    found = rows.mapInArrow(partial(_units, inner=inner, wanted=spark.sparkContext.broadcast(bitmap(repeats))), UNITS)
    return found.join(repeats, ["d1", "d2"]).filter("again or id > first_id")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; where one was cut, a single space or line break parts what is left."""
    parts, at = [], 0
    for start, end in sorted(spans):
        parts.append(text[at:start])
        at = max(at, end)
    parts.append(text[at:])
    out, last = [], "\n"
    for part in parts:
        cut = part.strip(" \t")
        if last == "\n":
            cut = cut.removeprefix("\n")
        elif cut and cut[0] != "\n":
            out.append(" ")
        if cut:
            out.append(cut)
            last = cut[-1]
    return "".join(out).strip("\n")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            texts, lists = piece.column("text").to_pylist(), piece.column("spans")
            found = lists.flatten()
            start, end = (found.field(i).to_numpy(zero_copy_only=False).tolist() for i in (0, 1))
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
            cleaned = [without(t, list(zip(start[i:j], end[i:j]))) if j > i else t for t, i, j in zip(texts, at, at[1:])]
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(cleaned, pa.string()), lists.is_valid()], ["row", "text", "cut"])


def remove_units(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with the spans cut out of their texts; rows without spans pass as they are, rows left empty go.

    A document is told by id and text, so repeated rows lose the same spans. Texts are shuffled once, to their spans.
    """
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(LAST)).alias("__id")
    per_row = spans.select(number(id_column), F.col("row").alias("__row"), F.struct("start", "end").alias("span")).groupBy("__id", "__row").agg(
        F.collect_set("span").alias("__spans"))
    joined = docs.select("*", number(id_column), F.xxhash64(text_column).alias("__row")).join(per_row, ["__id", "__row"], "left")
    others = [c for c in docs.columns if c != text_column]
    carried = joined.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), F.col(text_column).alias("text"), F.col("__spans").alias("spans"))
    cleaned = carried.mapInArrow(_cut, f"row {carried.schema['row'].dataType.simpleString()}, text string, cut boolean").filter("not cut or trim(text) != ''")
    back = {text_column: F.col("text")} | {c: F.col(f"row.c{i}") for i, c in enumerate(others)}
    return cleaned.select(*[back[c].alias(c) for c in docs.columns])
