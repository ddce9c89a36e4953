"""Toxicity by a classifier chain: a sparse linear model for each category, which sees the probabilities of those before it.

While training, those probabilities come from models that have not seen the row (out of fold), so that later models
learn how far to trust them on new texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from allotment.llm.arrays import NOT_WORD, U64, Words, constants, pieces, range_hash
from allotment.llm.sampling import smallest

#: A text's features are the words and the stems (first bytes) of words that it holds, however often, hashed.
DIMS = 1 << 20
STEMS = (4, 5, 6, 7, 8)
#: Labelled rows that training looks at.
TRAIN_ROWS = 6000
FOLDS, LEAST_ROWS, PENALTY, STEPS = 3, 4, 1.0, 120


def features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature number of every distinct word and stem of each text, of those in `wanted` if given."""
    words = Words(column, NOT_WORD)
    letters = constants("byte", 256)[words.data]
    found = []
    for k, salt in zip((0, *STEMS), constants("stem", len(STEMS) + 1)):
        own = words.end - words.start > k
        start = words.start[own]
        number = ((range_hash(letters, start, start + k if k else words.end[own]) ^ salt) % U64(DIMS)).astype(np.int64)
        doc = words.doc[own]
        if wanted is not None:
            some = wanted[number]
            number, doc = number[some], doc[some]
        found.append(np.unique(doc * DIMS + number))
    pairs = np.unique(np.concatenate(found))
    return pairs // DIMS, pairs % DIMS


@dataclass
class Linear:
    words: np.ndarray       # numbers of the words with a weight
    weights: np.ndarray
    earlier: np.ndarray     # weights of the earlier categories' probabilities
    bias: float
    threshold: float = 0.5


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(doc: np.ndarray, word: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression with an absolute penalty on words, by accelerated proximal gradients."""
    n, k = earlier.shape
    names, column, rows = np.unique(word, return_inverse=True, return_counts=True)
    often = rows >= LEAST_ROWS
    place = np.cumsum(often) - 1
    some = often[column]
    doc, column, names = doc[some], place[column[some]], names[often]
    d = len(names)
    dense = np.concatenate([earlier, np.ones((n, 1))], axis=1)
    value = np.zeros(d + k + 1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    value[-1] = np.log(share / (1 - share))
    ahead, momentum = value.copy(), 1.0

    def score(v):
        return np.bincount(doc, weights=v[:d][column], minlength=n) + dense @ v[d:]

    # largest curvature by a few power steps
    probe = np.full(len(value), 1.0)
    size = 1.0
    for _ in range(8):
        s = score(probe)
        probe = np.concatenate([np.bincount(column, weights=s[doc], minlength=d), dense.T @ s])
        size = np.linalg.norm(probe)
        probe /= max(size, 1e-12)
    step = 4 / max(size, 1e-12) * 0.9
    limit = PENALTY * step
    for _ in range(STEPS):
        slope = sigmoid(score(ahead)) - y
        moved = ahead - step * np.concatenate([np.bincount(column, weights=slope[doc], minlength=d), dense.T @ slope])
        moved[:d] = np.sign(moved[:d]) * np.maximum(np.abs(moved[:d]) - limit, 0)
        next_momentum = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = moved + (momentum - 1) / next_momentum * (moved - value)
        value, momentum = moved, next_momentum
    used = np.flatnonzero(value[:d])
    return Linear(names[used], value[used], value[d:-1], float(value[-1]))


def scores(model: Linear, doc: np.ndarray, word: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    place = np.searchsorted(model.words, word)
    place[place == len(model.words)] = 0
    known = model.words[place] == word if len(model.words) else np.zeros(len(word), bool)
    z = np.bincount(doc[known], weights=model.weights[place[known]], minlength=len(earlier)) if known.any() else np.zeros(len(earlier))
    return sigmoid(z + earlier @ model.earlier + model.bias)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where precision and recall of the out-of-fold probabilities are best together (F1)."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(p) + 1) + max(1, y.sum()))
    last = int(np.argmax(f1))
    below = p[order[last + 1]] if last + 1 < len(p) else 0.0
    return float((p[order[last]] + below) / 2)


def train(doc: np.ndarray, word: np.ndarray, targets: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """The chain for the columns of `targets`, in their order; doc is the row of each feature, fold the fold of each row."""
    earlier, chain = np.zeros((len(targets), 0)), []
    for y in targets.T:
        y = y.astype(float)
        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            inside = fold != f
            if not inside.any() or inside.all():
                unseen[~inside] = y.mean()
                continue
            place = np.cumsum(inside) - 1
            some = inside[doc]
            model = fit_linear(place[doc[some]], word[some], earlier[inside], y[inside])
            place, some = np.cumsum(~inside) - 1, ~inside[doc]
            unseen[~inside] = scores(model, place[doc[some]], word[some], earlier[~inside])
        model = fit_linear(doc, word, earlier, y)
        model.threshold = best_threshold(unseen, y)
        chain.append(model)
        earlier = np.column_stack([earlier, unseen])
    return chain


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            doc, word = features(piece.column("text"))
            ends = np.searchsorted(doc, np.arange(piece.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column("place"), piece.column("targets"), pa.ListArray.from_arrays(pa.array(ends), pa.array(word.astype(np.int32)))],
                                             ["place", "targets", "words"])


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_column: str = "doc_id", text_column: str = "text", rows: int = TRAIN_ROWS) -> list[Linear] | None:
    """A chain over 0/1 columns of `labels`, from at most `rows` labelled documents (those with the smallest hash of the id).

    Labels that are null, or whose document is missing, teach nothing; of several labels of one id the largest counts.
    Only the chosen labels are broadcast. None without any label.
    """
    known = labels.dropna(subset=[id_column, *categories]).groupBy(id_column).agg(*[F.max(c).cast("int").alias(c) for c in categories])
    place = F.xxhash64(F.lit("labels"), id_column)
    chosen = smallest(known.select(F.col(id_column).alias("id"), place.alias("place"), F.array(*categories).alias("targets")), "place", rows)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "id")
    found = texts.select("place", "targets", "text").mapInArrow(_features, "place long, targets array<int>, words array<int>").toArrow()
    if not found.num_rows:
        return None
    order = np.argsort(found["place"].to_numpy(), kind="stable")
    places, targets, words = found["place"].to_numpy()[order], found["targets"].to_pylist(), found["words"].combine_chunks()
    targets = np.array([targets[i] for i in order])
    parts = [np.asarray(words[int(i)].values) for i in order]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return train(doc, np.concatenate(parts).astype(np.int64), targets, (places.view(np.uint64) % U64(FOLDS)).astype(int))


def _apply(chain: list[Linear] | None, categories: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(DIMS, dtype=bool)
        for model in chain or ():
            wanted[model.words] = True
        for batch in batches:
            for piece in pieces(batch, "text"):
                earlier, flags = np.zeros((piece.num_rows, 0)), []
                doc, word = features(piece.column("text"), wanted)
                for model in chain or ():
                    p = scores(model, doc, word, earlier)
                    flags.append(p >= model.threshold)
                    earlier = np.column_stack([earlier, p])
                if chain is None:
                    earlier, flags = np.zeros((piece.num_rows, len(categories))), [np.zeros(piece.num_rows, bool)] * len(categories)
                others = [c for c in piece.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*map(piece.column, others), *(pa.array(c) for c in earlier.T.copy()), *map(pa.array, flags)],
                                                 [*others, *(f"p{i}" for i in range(len(categories))), *(f"f{i}" for i in range(len(categories)))])
    return run


def judged(docs: DataFrame, chain: list[Linear] | None, categories: list[str], keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns `keep` of every row with <category>_score (0 to 1) and <category> (score at or above the threshold that was
    best out of fold) for each category.

    Whole texts are read. A null or empty text has no words and is judged by the chain's bias alone; without a chain
    (nothing was labelled) all scores are 0. Repeated rows are each judged; other columns are ignored.
    """
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_column).alias("text"))
    schema = [f"k{i} {kind}" for i, kind in enumerate(kinds)] + [f"p{i} double" for i in range(len(categories))] + [f"f{i} boolean" for i in range(len(categories))]
    found = rows.mapInArrow(_apply(chain, categories), ", ".join(schema))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
                        *[F.col(f"p{i}").alias(f"{c}_score") for i, c in enumerate(categories)], *[F.col(f"f{i}").alias(c) for i, c in enumerate(categories)])
