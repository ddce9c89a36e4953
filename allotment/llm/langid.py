"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of several widths run over the bytes of a fixed-length window, each filter keeps its largest answer, and a
softmax layer turns those into probabilities. A filter over one-hot bytes is a table of weights by place and byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from allotment.llm.arrays import pieces, text_bytes
from allotment.llm.sampling import smallest

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled rows, and windows of each, that training looks at.
TRAIN_ROWS, TRAIN_WINDOWS = 6000, 4
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    tables: list[np.ndarray]            # by width: (width, 256, FILTERS)
    weights: np.ndarray                 # (all filters, langs)
    bias: np.ndarray
    pairs: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "pairs": {}}

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Largest answer of every filter in each window; tables of byte pairs halve the look-ups."""
        for k, table in enumerate(self.tables if not self.pairs else ()):
            for j in range(0, len(table) - 1, 2):
                self.pairs[k, j] = (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, -1)
        pair = windows[:, :-1].astype(np.uint16) * np.uint16(256) + windows[:, 1:]
        out = []
        for k, table in enumerate(self.tables):
            width, places = len(table), windows.shape[1] - len(table) + 1
            answer = None
            for j in range(0, width, 2):
                part = self.pairs[k, j][pair[:, j:j + places]] if j + 1 < width else table[j][windows[:, j:j + places]]
                answer = part if answer is None else np.add(answer, part, out=answer)
            out.append(answer.max(axis=1))
        return np.concatenate(out, axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.pooled(windows[i:i + 128]) for i in range(0, len(windows), 128)]) @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 4, steps: int = 1200, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross entropy, for `epochs` rounds, or more until there are `steps` steps; gradients reach only the bytes
    under each filter's largest answer."""
    epochs = max(epochs, -(-steps // -(-len(windows) // batch)))
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    weights, bias = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    params = [*tables, weights, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    filters, step = np.arange(FILTERS), 0
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for begin in range(0, len(order), batch):
            x, y = windows[order[begin:begin + batch]], labels[order[begin:begin + batch]]
            rows, peaks, pooled = np.arange(len(x)), [], []
            for table in tables:
                width, places = len(table), x.shape[1] - len(table) + 1
                answer = table[0][x[:, :places]]
                for j in range(1, width):
                    answer += table[j][x[:, j:j + places]]
                peaks.append(answer.argmax(axis=1))
                pooled.append(np.take_along_axis(answer, peaks[-1][:, None, :], 1)[:, 0])
            h = np.concatenate(pooled, axis=1)
            z = h @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[rows, y] -= 1
            p /= len(x)
            grads = [np.zeros_like(t) for t in tables] + [h.T @ p, p.sum(axis=0)]
            dh = p @ weights.T
            for k, table in enumerate(tables):
                part = dh[:, k * FILTERS:(k + 1) * FILTERS]
                for j in range(len(table)):
                    np.add.at(grads[k][j], (x[rows[:, None], peaks[k] + j], filters[None, :]), part)
            step += 1
            speed = rate * (1 - step / (total + 1))
            for value, grad, (m, v) in zip(params, grads, moments):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= speed * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return Network(langs, tables, weights, bias)


def fit(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
        rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS) -> Network | None:
    """A network for the labels of `labelled`, from at most `rows` of its different rows with letters (those with the smallest hash of id and
    text) and at most `windows` windows of each, spread over the whole text and cut by Spark. None without any label."""
    size = F.octet_length(text_column)
    spread = F.sequence(F.lit(0), F.lit(windows - 1))
    starts = F.array_distinct(F.transform(spread, lambda i: (F.greatest(size - WINDOW, F.lit(0)) * i / F.lit(max(1, windows - 1))).cast("int")))
    cut = F.transform(starts, lambda s: F.substring(F.encode(F.col(text_column), "UTF-8"), s + 1, F.lit(WINDOW)))
    sample = labelled.filter(F.col(lang_column).isNotNull() & F.col(text_column).rlike(r"\p{L}")).select(
        F.xxhash64(F.lit("language"), F.col(id_column), F.xxhash64(text_column)).alias("place"), F.col(lang_column).alias("lang"), cut.alias("windows"))
    found = smallest(sample, "place", rows).collect()
    if not found:
        return None
    langs = sorted({r.lang for r in found})
    bytes_, labels = [], []
    for r in found:
        for w in r.windows:
            bytes_.append(bytes(w).ljust(WINDOW, b"\0"))
            labels.append(langs.index(r.lang))
    return train(np.frombuffer(b"".join(bytes_), np.uint8).reshape(-1, WINDOW), np.array(labels), langs)


def applied(network: Network | None, text: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                data, bounds = text_bytes(piece.column(text))
                sizes = np.diff(bounds)
                count = np.maximum(1, -(-sizes // WINDOW))
                out = np.zeros(int(count.sum()) * WINDOW, dtype=np.uint8)
                first = np.cumsum(count) - count
                out[np.arange(len(data)) + np.repeat(first * WINDOW - bounds[:-1], sizes)] = data
                langs, scores = [UNKNOWN] * len(sizes), np.zeros(len(sizes))
                if network is not None:
                    p = network.probabilities(out.reshape(-1, WINDOW)).astype(np.float64)
                    place = np.arange(len(p)) - np.repeat(first, count)
                    share = np.clip(np.repeat(sizes, count) - place * WINDOW, 1, WINDOW)
                    mean = np.add.reduceat(p * share[:, None], first) / np.add.reduceat(share, first)[:, None]
                    langs, scores = [network.langs[i] for i in mean.argmax(axis=1)], np.minimum(mean.max(axis=1), 1.0)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in piece.schema.names if c != "text"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 [*(c for c in piece.schema.names if c != "text"), "lang_pred", "score"])
    return run


def predict(docs: DataFrame, network: Network | None, keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns `keep` of every row with lang_pred and score (0 to 1).

    All windows of a text are looked at, the last one filled up with zeros; the score is their mean probability,
    weighted by bytes. Texts that are null or without a letter, and all texts if nothing was learned, are `und` with 0.
    """
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
                       *([] if text_column in keep else [F.col(text_column).alias("text")]))  # a text goes to Python once
    schema = ", ".join([f"k{i} {kind}" for i, kind in enumerate(kinds)] + ["letters boolean", "lang_pred string", "score double"])
    found = rows.mapInArrow(applied(network, f"k{keep.index(text_column)}" if text_column in keep else "text"), schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
                        F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, id_column: str = "doc_id", **options) -> Network | None:
    """A network from the rows with an id and a language that are not held out."""
    return fit(docs.filter(F.col(id_column).isNotNull() & ~held_out(id_column)), id_column, **options)


def identify(docs: DataFrame, network: Network | None, id_column: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; a null id is never held out, nor learned from."""
    rows = docs.select(F.col(id_column), held_out(id_column).alias("held_out"), "text")
    return predict(rows, network, [id_column, "held_out"])
