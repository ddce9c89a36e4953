"""Spelling variants: words that differ by one code point, found through pairs of trie nodes.

Every prefix of a word is a node of the forward trie, every suffix a node of the trie of reversed words. Two words of
equal length differ in one code point if they have the same (prefix node, suffix node) around it; a word lacks one that
another has if its nodes around an inserted place are the other's nodes around a skipped code point. All are equalities of
two integers, so neighbours are found by grouping, exactly and without comparing words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from allotment.llm.arrays import U64, constants, mix, range_hash
from allotment.sources.shared import cut

LETTERS = "A-Za-zÀ-ÿ"
#: A text is read in stretches of about this many characters, cut where no run of letters is; words of a stretch are counted together.
STRETCH = 1 << 20
ROOT = 0


def stretches(text: str, other: re.Pattern) -> Iterator[str]:
    """The text in parts that end outside a run of letters."""
    at = 0
    while len(text) - at > STRETCH:
        gap = other.search(text, at + STRETCH)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def typed(run: str, prefix: int | None, every: int | None) -> str:
    """The run, or the run without one code point if its crc32 after `prefix` is a multiple of `every`."""
    if prefix is None or not every:
        return run
    h = zlib.crc32(run.encode(), prefix)
    return run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]


def _count(batches: Iterator[pa.RecordBatch], letters: str, least: int, every: int | None) -> Iterator[pa.RecordBatch]:
    runs, other = re.compile(f"[{letters}]{{{least},}}"), re.compile(f"[^{letters}]")
    counted: Counter = Counter()
    for batch in batches:
        for name, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            prefix = None if name is None else zlib.crc32(f"{name}:".encode())
            for part in stretches(text.as_py() or "", other):
                for run, n in Counter(runs.findall(part.encode().lower().decode())).items():
                    word = typed(run, prefix, every)
                    if len(word) >= least:
                        counted[word] += n
            if len(counted) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counted)), pa.array(list(counted.values()), pa.int64())], ["word", "n"])
                counted.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, letters: str = LETTERS, least: int = 7, occurrences: int = 2, every: int | None = None,
               id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): the words of at least `least` code points that occur `occurrences` times in all whole texts.

    Words are maximal runs of `letters`, A-Z lower-cased. With `every`, a run whose crc32 (of id, colon and run) is a
    multiple of it lacks one code point, a planted misspelling. Counted per task first, then in one shuffle of words.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = rows.mapInArrow(partial(_count, letters=letters, least=least, every=every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


class Paths:
    """Nodes of all prefixes and suffixes of the words of an Arrow column.

    code: code points of all words; first: of each word, n + 1; word: word of each node place, one more per word than it has code
    points; before, behind: node of what stands before and behind each place.
    """

    def __init__(self, words: pa.Array, seed: str):
        texts = words.to_pylist()
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.word = np.repeat(np.arange(len(texts)), self.size + 1)
        self.place = np.arange(len(self.word)) - (self.first[:-1] + np.arange(len(texts)))[self.word]
        start, end = self.first[:-1][self.word], self.first[1:][self.word]
        at = start + self.place
        values = mix((self.code + 1).astype(np.uint64) * constants(seed, 1))
        self.before = np.where(self.place > 0, range_hash(values, start, at).view(np.int64), ROOT)
        self.behind = np.where(at < end, range_hash(values, at, end).view(np.int64), ROOT)

    def nodes(self) -> np.ndarray:
        """Distinct (trie, node, parent, code point): the edges of both tries."""
        inner = np.flatnonzero(self.place[1:] > 0) + 1                      # places behind a code point
        code = self.code[(self.first[:-1][self.word] + self.place)[inner] - 1]
        forward = np.stack([np.zeros(len(inner), np.int64), self.before[inner], self.before[inner - 1], code], axis=1)
        backward = np.stack([np.ones(len(inner), np.int64), self.behind[inner - 1], self.behind[inner], code], axis=1)
        return np.unique(np.concatenate([forward, backward]), axis=0)


def _parts(batch: pa.RecordBatch, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of words with about `size` characters each."""
    total = np.cumsum([len(w) for w in batch.column("word").to_pylist()])
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + size, "right")))
        yield batch.slice(first, last - first)
        first = last


def _nodes(batches: Iterator[pa.RecordBatch], seed: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            rows = Paths(part.column("word"), seed).nodes()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], ["trie", "node", "parent", "code"])


KEYS = "before long, behind long, word_id long, n long, code int, fresh boolean"


def _keys(batches: Iterator[pa.RecordBatch], seed: str) -> Iterator[pa.RecordBatch]:
    """Node pairs around every skipped code point (code, and whether it differs from the one before) and every inserted place (code -1)."""
    for batch in batches:
        for part in _parts(batch):
            p = Paths(part.column("word"), seed)
            last = np.flatnonzero(p.place == p.size[p.word])
            skipped = np.flatnonzero(p.place < p.size[p.word])
            code = p.code[(p.first[:-1][p.word] + p.place)[skipped]]
            same = np.zeros(len(skipped), dtype=bool)
            same[1:] = (code[1:] == code[:-1]) & (p.place[skipped[1:]] > 0)
            every = np.arange(len(p.word))
            ids, n = p.before[last], part.column("n").to_numpy()
            of = np.concatenate([p.word[skipped], p.word])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p.before[skipped], p.before])), pa.array(np.concatenate([p.behind[skipped + 1], p.behind])),
                 pa.array(ids[of]), pa.array(n[of]), pa.array(np.concatenate([code, np.full(len(every), -1)]).astype(np.int32)),
                 pa.array(np.concatenate([~same, np.ones(len(every), dtype=bool)]))], [c.split()[0] for c in KEYS.split(", ")])


def _ids(batches: Iterator[pa.RecordBatch], seed: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            p = Paths(part.column("word"), seed)
            yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(p.before[p.place == p.size[p.word]])], ["word", "n", "word_id"])


def numbered(words: DataFrame, seeds: tuple[str, ...] = ("first", "second", "third", "fourth")) -> str:
    """The first of `seeds` whose node numbers are one to one in both tries of `words`.

    A node's number is a 64-bit digest of its path. The tries are one to one if no number has two parents or two code points, and
    none is the root's: by induction from the root, equal numbers then mean equal paths. One aggregation of edges tells.
    """
    for seed in seeds:
        edges = words.select("word").mapInArrow(partial(_nodes, seed=seed), "trie long, node long, parent long, code long")
        twice = edges.groupBy("trie", "node").agg(F.min("parent").alias("p"), F.max("parent").alias("q"), F.min("code").alias("c"), F.max("code").alias("d"))
        if twice.filter((F.col("p") != F.col("q")) | (F.col("c") != F.col("d")) | (F.col("node") == ROOT)).isEmpty():
            return seed
    raise ValueError("no seed numbers the nodes one to one; give others")


def neighbours(words: DataFrame, seed: str) -> DataFrame:
    """(word_id, n_near, candidate, candidate_n): a row per word and node pair that has company.

    n_near counts the near words met at this pair, each near word at one pair only; candidate is the most frequent of them (ties:
    smallest in code-point order among these). Words (word, n) must be distinct.

    A pair's group has one word per code point that can stand in the gap and at most one word without any, so it is no
    larger than the alphabet plus one; it is not turned into pairs of words. A code point equal to the one before gives the same
    shorter word as that one, so only the first of equal ones in a row counts for insertions and deletions.
    """
    keys = words.select("word", "n").mapInArrow(partial(_keys, seed=seed), KEYS)
    member = F.struct("n", (-F.col("code")).alias("place"), "word_id", "fresh")
    groups = keys.groupBy("before", "behind").agg(F.sort_array(F.collect_list(member), False).alias("all")).filter(F.size("all") > 1)
    split = groups.select(F.filter("all", lambda m: m["place"] < 1).alias("skipped"), F.get(F.filter("all", lambda m: m["place"] == 1), F.lit(0)).alias("shorter"))
    split = split.withColumn("fresh", F.filter("skipped", lambda m: m["fresh"])).filter("size(skipped) > 0")
    shorter, fresh = F.col("shorter"), F.col("fresh")
    of_shorter = F.when(shorter.isNotNull() & (F.size(fresh) > 0), F.array(F.struct(
        shorter["word_id"].alias("word_id"), shorter["n"].alias("n"), F.size(fresh).alias("n_near"), F.get(fresh, F.lit(0))["word_id"].alias("candidate"), F.get(fresh, F.lit(0))["n"].alias("candidate_n"))))
    other = lambda i: F.get(F.col("skipped"), F.when(i == 0, 1).otherwise(0))
    of_skipped = F.transform("skipped", lambda m, i: F.struct(m["word_id"].alias("word_id"), m["n"].alias("n"), (F.size("skipped") - 1).alias("n_near"),
                                                              other(i)["word_id"].alias("candidate"), other(i)["n"].alias("candidate_n")))
    of_longer = F.when(shorter.isNotNull(), F.transform(fresh, lambda m: F.struct(m["word_id"].alias("word_id"), m["n"].alias("n"), F.lit(1).alias("n_near"),
                                                                                 shorter["word_id"].alias("candidate"), shorter["n"].alias("candidate_n"))))
    rows = F.concat(*[F.coalesce(x, F.array().cast("array<struct<word_id:bigint,n:bigint,n_near:int,candidate:bigint,candidate_n:bigint>>"))
                      for x in (of_shorter, of_skipped, of_longer)])
    return split.select(F.explode(rows).alias("r")).select("r.*").filter("n_near > 0")


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n and root of distinct words (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. form is the near word of largest n (ties:
    smallest in code-point order) if that n is at least factor * the word's; else null. root follows forms to the last one, itself
    where there is none. n_near is 0 for words without company. An empty table has no rows; a null word must not be there.
    """
    if factor < 2:
        raise ValueError("forms must grow, so the factor is 2 or more")
    words = cut(words.select("word", F.col("n").cast("long").alias("n")), "words")
    seed = numbered(words)
    named = cut(words.mapInArrow(partial(_ids, seed=seed), "word string, n long, word_id long"), "named")
    met = cut(neighbours(words, seed), "near")
    near = met.groupBy("word_id").agg(F.sum("n_near").alias("n_near"), F.max("candidate_n").alias("best"))
    asked = met.filter(F.col("candidate_n") >= F.col("n") * factor)
    asked = asked.join(near.select("word_id", "best"), "word_id").filter("candidate_n = best").select("word_id", "candidate").distinct()
    told = asked.join(named.select(F.col("word_id").alias("candidate"), F.col("word").alias("form"), F.col("n").alias("form_n")), "candidate")
    forms = cut(told.groupBy("word_id").agg(F.min(F.struct("form", "form_n", "candidate")).alias("f")).select("word_id", F.col("f.candidate").alias("root_id"), "f.form", "f.form_n"), "forms")
    roots = forms.select("word_id", "root_id")
    while True:  # a form is at least `factor` times as frequent, so a chain has few steps, and each round halves them
        further = roots.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("next"))
        moved = cut(roots.join(further, "root_id", "left").select("word_id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word_id", "root_id")
        if moved.filter("moved").isEmpty():
            break
    ends = roots.join(named.select(F.col("word_id").alias("root_id"), F.col("word").alias("root")), "root_id").select("word_id", "root")
    full = named.join(near.select("word_id", "n_near"), "word_id", "left").join(forms.select("word_id", "form", "form_n"), "word_id", "left").join(ends, "word_id", "left")
    return full.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, every: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`variants` of the `vocabulary` of whole texts.

    Null, empty and white texts have no words; repeated rows count as often as they are there; a null id plants no
    misspelling; other columns are ignored.
    """
    return variants(vocabulary(docs, every=every, id_column=id_column, text_column=text_column))
