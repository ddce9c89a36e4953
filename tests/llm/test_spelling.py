"""Spelling variants against edits enumerated in plain Python."""

import re
import zlib
from collections import Counter

from hypothesis import given, settings, strategies as st
from llm_rows import FOLDER, no_docs, odd_docs  # noqa: F401
import pytest

from allotment.llm import spelling
from allotment.llm.queries import QUERIES

LOW = {i: i + 32 for i in range(65, 91)}


def plain_words(rows, least=7):
    count = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = 1 if name is None else zlib.crc32(f"{name}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                count[run] += 1
    return {w: n for w, n in count.items() if n > 1}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words, factor=10):
    """By all edits that end in a word: skips of it, and of what others lack."""
    skips = {}
    for w in words:
        for i in range(len(w)):
            skips.setdefault((w[:i], w[i + 1:]), set()).add(w)
    form, found = {}, {}
    for w in words:
        close = {x for i in range(len(w)) for x in skips[w[:i], w[i + 1:]]} | {x for i in range(len(w) + 1) for x in skips.get((w[:i], w[i:]), ())}
        close |= {w[:i] + w[i + 1:] for i in range(len(w)) if w[:i] + w[i + 1:] in words}
        found[w] = close - {w}
        best = min(found[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= factor * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(found[w]), words.get(form[w])))
    return out, found


def test_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want, found = plain_variants(plain_words(rows))
    got = [tuple(r) for r in QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.01").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(f is not None for _, f, *_ in got) > 20
    some = sorted(found)[::37]
    assert all(found[w] == {x for x in found if near(w, x)} for w in some[:40])


def test_crowded_words(spark):
    """Few letters, so that groups are full, letters repeat and chains are long."""
    tables = []

    @given(st.dictionaries(st.text("abÿ", min_size=1, max_size=6), st.integers(2, 3000), min_size=1, max_size=60))
    @settings(max_examples=12, deadline=None)
    def gather(words):
        tables.append(words)
    gather()
    tables.append({"a" * 9: 2, "a" * 10: 20, "a" * 11: 200, "a" * 12: 2000, "a" * 8 + "b": 20, "b" + "a" * 8: 20, "x" * 3000: 5, "x" * 2999 + "y": 50, "x" * 2999: 500})
    for words in tables[-8:]:
        got = {tuple(r) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
        assert got == plain_variants(words)[0]


def test_odd_rows(spark, odd_docs, no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.spelling_variants(odd_docs, every=31).collect()} == plain_variants(plain_words(rows))[0]
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"), factor=1)


def test_stretches_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 10)
    text = "aa bbbbbb cccccccccccccccccccc dd, ee " * 5
    parts = list(spelling.stretches(text, re.compile("[^a-z]")))
    assert "".join(parts) == text and len(parts) > 3
    assert Counter(w for p in parts for w in re.findall("[a-z]+", p)) == Counter(re.findall("[a-z]+", text))


def test_clashing_numbers_are_told(spark, monkeypatch):
    words = spark.createDataFrame([("abc", 2), ("abd", 3), ("xbc", 4)], "word string, n long")
    assert spelling.numbered(words) == "first"
    with pytest.raises(ValueError):
        spelling.numbered(words, ())
