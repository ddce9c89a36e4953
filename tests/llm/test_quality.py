"""Quality rules on odd rows and in plain Python; the SQL twin covers the given table."""

import re
from collections import Counter

from hypothesis import given, settings, strategies as st
from llm_rows import FOLDER, no_docs, odd_docs, odd_texts  # noqa: F401
from pyspark.sql import functions as F

from allotment.llm import quality
from allotment.llm.queries import ORACLES, QUERIES


def repeated(words, window=quality.WINDOW):
    seen = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    return len({i + k for i in range(len(words) - window + 1) if seen[tuple(words[i:i + window])] > 1 for k in range(window)})


def test_same_as_sql(spark, con):
    from check import compare
    assert compare(QUERIES["op12_quality_rules"](spark, FOLDER), ORACLES["op12_quality_rules"], con) == "ok"


def test_repeated_words(spark):
    lists = []

    @given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 12), st.integers(1, 3))
    @settings(max_examples=150, deadline=None)
    def gather(words, take, times):
        lists.append([str(w) for w in words + words[:take] * times])
    gather()
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, words array<string>")
    got = dict(rows.select("i", quality.repeated_words(F.col("words"))).collect())
    assert [got[i] for i in range(len(lists))] == [repeated(w) for w in lists]


def test_measures_of_odd_rows(spark, odd_docs, no_docs):
    assert quality.judged(no_docs).count() == 0
    got = quality.judged(odd_docs).collect()
    assert len(got) == len(odd_texts())
    want = Counter()
    for i, text in odd_texts():
        words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        want[i, len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), repeated(words)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed for r in got if r.n_words < 20)


def test_rules(spark):
    good = "The cat sat on the mat and it was as warm as that old house by the sea for all of us there."
    texts = {"good": good, "symbols": good.replace(" ", " ## "), "stop_words": "lorem " * 3 + " ".join(f"word{i}" for i in range(30)),
             "long_words": good + " " + "x" * 2000, "short_words": "a of a in a is a to a by a at a as a or a on a de a la a el a du a x a y z z z z z z z z".replace("of", "o"),
             "bullets": "\n".join(f"- the item of {i}" for i in range(12)), "ellipses": "\n".join(f"the end of {i} is ..." for i in range(9)),
             "duplicate_lines": "\n".join(["to the end", "of it all"] * 5 + ["in the sea of " + str(i) for i in range(3)])}
    rows = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id string, text string, failed string")
    got = {r.doc_id: r for r in quality.judged(rows).collect()}
    for name, row in got.items():
        assert row.failed == ("" if name == "good" else name), (name, row)
    assert got["good"].kept and not got["bullets"].kept
    assert quality.judged(rows, []).filter("failed != ''").count() == 0


def test_one_projection(spark):
    plan = QUERIES["op12_quality_rules"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("split(") == 2  # words and lines are made once, not in every measure
