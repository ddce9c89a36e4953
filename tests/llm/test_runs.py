"""Periodic runs against every period of every stretch in plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from llm_rows import FOLDER, no_docs, odd_docs, odd_texts  # noqa: F401

from allotment.llm.queries import QUERIES
from allotment.llm.runs import periodic_runs, planted, runs_of


def plain_runs(words, exponent=4, least=6):
    """Maximal stretches that keep a period, for each period in turn; those of a smaller period go."""
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, out = np.array([code[w] for w in words], dtype=np.int64), []
    for q in range(1, len(x) // exponent + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]]).astype(int)
        for start, end in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            part = x[start:end + q]
            if len(part) >= max(least, exponent * q) and not any((part[p:] == part[:-p]).all() for p in range(1, q)):
                out.append((int(start), len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    text = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.lists(st.tuples(st.integers(1, 9), st.integers(3, 7)), max_size=3))
@settings(max_examples=300, deadline=None)
def test_runs_of_sequences(texts, extra):
    for period, times in extra:
        texts[0] = texts[0] + [i % period % 3 for i in range(period)] * times + [7]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    names = np.array([d * 10 + w for d, t in enumerate(texts) for w in t], dtype=np.int64)
    size = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(size)])
    start, length, period = runs_of(names, doc, size, 4, 6)
    want = [(int(first[d]) + s, n, q) for d, t in enumerate(texts) for s, n, q in plain_runs(t)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want


def test_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect())
    assert got == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark, odd_docs, no_docs):
    got = periodic_runs(odd_docs).collect()
    assert len(got) == len(odd_texts()) and periodic_runs(no_docs).count() == 0
    by = {(r.doc_id, r.collapsed): r for r in got}
    assert by[1, ""].n_words == 0 and by[2, ""].runs == [] and by[3, ""].n_words == 0
    assert by[5, "other words here"].runs == [] and (None, "") in by
    assert next(r for r in got if r.doc_id == 7).n_words == 40_000
    rows = spark.createDataFrame([(1, "a b  a\tb a b\na b c c c c c c", "x", 3)], "doc_id long, text string, runs string, collapsed int")
    row = periodic_runs(rows).first()
    assert [tuple(r) for r in row.runs] == [(0, 8, 2), (8, 6, 1)]
    assert row.collapsed == "a b c"


def test_small_exponents_are_refused(spark, no_docs):
    with pytest.raises(ValueError):
        periodic_runs(no_docs, exponent=2)


def test_long_text_of_one_word(spark):
    row = periodic_runs(spark.createDataFrame([(1, "no " * 300_000)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 1)] and row.collapsed == "no"


def test_planting_keeps_null_ids():
    import pyarrow as pa
    assert planted(pa.array([None, None], pa.int64()), np.array([0, 3, 3]), np.array([3, 0])).tolist() == [0, 1, 2]
