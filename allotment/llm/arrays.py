"""Whole Arrow batches of texts as numpy arrays: words, word hashes, code point offsets.

Spark hands tasks Arrow batches; the helpers below cut a batch into pieces of about PIECE bytes (a longer text is a
piece of its own, whole), so that a task needs memory for one piece at a time and no Python loop runs over words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
U64 = np.uint64
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def byte_table(chosen) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chosen)] = True
    return table


WHITE = byte_table(SPACES)
#: everything in ASCII but digits and small letters
NOT_WORD = byte_table(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the n + 1 bounds; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE):
    """Slices of a batch with about `size` bytes of text each."""
    _, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        last = min(last, batch.num_rows, first + 4096)
        yield batch.slice(first, last - first)
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=None)
def constants(name: str, n: int) -> np.ndarray:
    """n odd 64-bit numbers, the same on every machine."""
    seed = U64(int.from_bytes(name.encode()[:7].ljust(7, b"."), "little"))
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + seed) | U64(1)


BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, PIECE + 65536), base, dtype=np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if n <= PIECE + 65536:
            _powers[base] = known
    return known[:n]


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end] for many ranges, from one running sum (all modulo 2^64)."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(BASE, n), out=total[1:])
    h = (total[end] - total[start]) * powers(BASE_INVERSE, n + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def wide(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, bytes and number of the code points from U+0600 on."""
    at = np.flatnonzero(raw >= 0xD8)
    lead = raw[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & np.array([0x1F, 0x0F, 0x07])[size - 2]
    for i in (1, 2, 3):
        more = raw[np.minimum(at + i, len(raw) - 1)]
        code = np.where(i < size, code << 6 | (more & 0x3F), code)
    return at, size, code


class Words:
    """Words of all texts of an Arrow column, in order.

    data: bytes, A-Z lower-cased; bounds: of texts in bytes; start, end: of words in bytes; doc: text of each word;
    first: the first word of each text, n + 1 of them. `alone` gives first and last byte + 1 of what is a word by itself.
    """

    def __init__(self, column: pa.Array, separators: np.ndarray, alone=None):
        raw, self.bounds = text_bytes(column)
        self.raw, self.data = raw, LOWER[raw]
        inside = ~separators[self.data]
        n = len(raw)
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = self.bounds[1:-1]
            edges = edges[(edges > 0) & (edges < n)]
            begins[edges] = inside[edges]
            ends[edges - 1] = inside[edges - 1]
        if alone is not None:
            at, to = alone(raw)
            begins[at], ends[to - 1] = True, True
            after, before = to[to < n], at[at > 0] - 1
            begins[after] |= inside[after]
            ends[before] |= inside[before]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return range_hash(constants("byte", 256)[self.data], self.start, self.end)

    def code_points(self) -> np.ndarray:
        """Code points before each byte, counted over all texts; one more entry at the end."""
        counted = np.zeros(len(self.raw) + 1, dtype=np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=counted[1:])
        return counted
