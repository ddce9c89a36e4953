"""Order-preserving packing of token streams by dynamic programming over cuts at document and sentence ends."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from allotment.llm.arrays import LOWER, pieces, text_bytes

LENGTH = 4096
END_ID = 2
#: Powers of two below this are no aim of their own.
SHORTEST = 512
#: Padding tokens that one cut inside a document is worth: after a sentence, or within one.
SENTENCE_CUT, INNER_CUT = 8, 64
#: Tokens looked at together; what a look leaves open goes into the next one, so the bound costs no padding.
LOOK = 1 << 19
#: Distinct words whose ids a worker remembers; beyond that it starts afresh.
TABLE = 400_000
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long")
_SENTENCE = re.compile(r"[.!?]+[\"')\]]*$")
_tokenizers: dict[str, object] = {}


def padding(n: int) -> int:
    """A sequence is filled up to LENGTH, unless its length is a power of two."""
    return 0 if n & (n - 1) == 0 else LENGTH - n


class Encoder:
    """Token ids of whole texts, by way of the distinct words of a batch.

    For tokenizers that lower-case, and that drop white space and part letters from punctuation before they look at
    words (as a lower-casing word BPE does), the ids of a text are those of its white-space separated words in order,
    a full stop behind a letter being a word of its own. So each distinct word is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.size, self.stops = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, words: list[str]) -> None:
        """Words of letters only are encoded as one text, in which each ends with an id that ends words."""
        words.sort(key=str.isalpha)
        ids, sizes, letters = [], [], sum(map(str.isalpha, words))
        for start in [*range(0, len(words) - letters, 4096), *range(len(words) - letters, len(words), 4096)]:
            some = words[start:min(start + 4096, len(words) - letters if start < len(words) - letters else len(words))]
            if start >= len(words) - letters:
                got = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                last = np.flatnonzero(self.closing[got])
                if len(last) == len(some):
                    ids.append(got)
                    sizes += np.diff(last, prepend=-1).tolist()
                    continue
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes += map(len, lists)
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ids, self.size = np.concatenate([self.ids, *ids]), np.concatenate([self.size, np.array(sizes, np.int64)])
        self.stops = np.concatenate([self.stops, np.array([_SENTENCE.search(w) is not None for w in words])])
        self.begin = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, how many each text has, and behind which ids sentences end."""
        data, bounds = text_bytes(texts)
        texts, small = (pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(d)) for d in (data, LOWER[data]))
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, small)  # special tokens stay as they are
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), "([a-zà-öø-ÿ])([.,;:!?])", "\\1 \\2")
        split = pc.split_pattern(texts, " ")
        first = np.asarray(split.offsets)
        coded = split.values[first[0]:first[-1]].dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) + len(names) > TABLE:
            self.clear()
        if new := [w for w in names if w not in self.known]:
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[np.asarray(coded.indices)]
        n = self.size[number]
        upto = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=upto[1:])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.begin[number] - upto[:-1], n)]
        return ids, np.diff(upto[first - first[0]]), upto[1:][self.stops[number] & (n > 0)]


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def best_cuts(ends: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> list[int]:
    """Where to end sequences: positions out of `ends`, the last one included, with the least padding plus cut costs.

    ends rise; no two neighbours (nor 0 and the first) are more than `length` apart. The cost of a sequence that is
    filled up falls by one with each token in it, so the best start within reach is the front of a queue that keeps
    the costs up to a start plus its place in rising order; powers of two are looked up besides.
    """
    places = np.concatenate([[0], ends])
    sources = []
    power = SHORTEST
    while power < length:
        found = np.searchsorted(places, ends - power)
        sources.append(np.where((ends >= power) & (places[found] == ends - power), found, -1))
        power *= 2
    jumps = np.array(sources).T
    jumping = set((np.flatnonzero((jumps >= 0).any(axis=1)) + 1).tolist())
    at, cost = places.tolist(), [0, *costs.tolist()]
    value, back, keys = [0] * len(at), [0] * len(at), [0] * len(at)
    queue: deque[int] = deque()
    for j in range(1, len(at)):
        here = at[j]
        key = keys[j - 1]
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j - 1)
        while at[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        best = keys[i] + length - here
        if j in jumping:
            for k in jumps[j - 1].tolist():
                if k >= 0 and value[k] < best:
                    best, i = value[k], k
        value[j], back[j], keys[j] = best + cost[j], i, best + cost[j] + here
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """All places where a cut may be, and what it costs; long stretches without any get one every LENGTH tokens."""
    cost = np.full(total + 1, -1, dtype=np.int16)
    cost[sentence_ends] = SENTENCE_CUT
    cost[doc_ends] = 0
    cost[total] = 0
    cost[0] = -1
    ends = np.flatnonzero(cost >= 0)
    gaps = np.diff(ends, prepend=0)
    for e, g in zip(ends[gaps > LENGTH].tolist(), gaps[gaps > LENGTH].tolist()):
        cost[np.arange(e - g + LENGTH, e, LENGTH)] = INNER_CUT
    ends = np.flatnonzero(cost >= 0)
    return ends, cost[ends]


class Packer:
    """Packs the documents of one partition in their order; keeps the open end between looks."""

    def __init__(self, partition: int):
        self.sequence = partition << 33
        self.tokens = np.zeros(0, np.uint32)
        self.ends = np.zeros(0, np.int64)      # of documents, in self.tokens
        self.sentences = np.zeros(0, np.int64)
        self.docs: list[tuple] = []             # id, tokens, tokens before self.tokens

    def add(self, docs: list[tuple], tokens: np.ndarray, ends: np.ndarray, sentences: np.ndarray) -> None:
        n = len(self.tokens)
        self.tokens = np.concatenate([self.tokens, tokens])
        self.ends, self.sentences = np.concatenate([self.ends, ends + n]), np.concatenate([self.sentences, sentences + n])
        self.docs += docs

    def pack(self, finish: bool) -> list[tuple]:
        """Rows of the sequences that are settled; unless it is the end, the last two stay open."""
        if not len(self.tokens):
            return []
        cuts = best_cuts(*cut_points(self.ends, self.sentences, len(self.tokens)))
        if not finish:
            cuts = cuts[:-2]
        rows, begin, d = [], 0, 0
        for end in cuts:
            at, padded = begin, padding(end - begin)
            while at < end:
                doc, count, before = self.docs[d]
                first = int(self.ends[d - 1]) if d else 0
                stop = min(end, int(self.ends[d]))
                piece = self.tokens[at:stop].astype("<u4").tobytes()
                rows.append((doc, before + at - first, stop - at, zlib.crc32(piece), count, self.sequence, at - begin, padded))
                d += stop == int(self.ends[d])
                at = stop
            self.sequence += 1
            begin = end
        if begin:
            first = int(self.ends[d - 1]) if d else 0
            kept = self.docs[d:]
            if kept and begin > first:
                kept[0] = (*kept[0][:2], kept[0][2] + begin - first)
            self.docs, self.ends = kept, self.ends[d:] - begin
            self.tokens = self.tokens[begin:]
            self.sentences = self.sentences[self.sentences > begin] - begin
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def packer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, state = encoder(path), Packer(TaskContext.get().partitionId())
        for batch in batches:
            for piece in pieces(batch, "text", 4 << 20):
                ids, counts, stops = made.encode(piece.column("text"))
                ends = np.cumsum(counts + 1)
                tokens = np.insert(ids, np.cumsum(counts), END_ID)
                sentences = stops + np.searchsorted(np.cumsum(counts), stops, "left")  # one end id per earlier document
                names = piece.column("doc_id").to_pylist()
                state.add([(d, c + 1, 0) for d, c in zip(names, counts.tolist())], tokens, ends, sentences)
                if len(state.tokens) >= LOOK and (rows := state.pack(False)):
                    yield _batch(rows)
        if rows := state.pack(True):
            yield _batch(rows)
    return run


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, in the order of the rows.

    A document is its token ids and then id 2; null and empty texts have only that one. Each task packs the rows of
    its partition (a part of a file, so nothing is shuffled and a lost task repeats itself): cuts lie at document or
    sentence ends, within a sentence only where it has more than 4096 tokens, and least padding plus cut costs decides.
    Returns per piece: the id, start and length within the document's ids, ids_crc32 of the ids as little-endian
    32-bit numbers, doc_tokens, sequence_id, offset within the sequence, and padded (tokens that fill the sequence up).
    Repeated rows and null ids are packed like others; other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(packer(tokenizer), PIECES).withColumnRenamed("doc_id", id_column)
