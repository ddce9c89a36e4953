"""Chat formatting, pages, urls and vectors against brute force or SQL, and on odd rows."""

import hashlib
import json

import numpy as np
import pytest
from llm_rows import FOLDER
from pyspark.sql import functions as F

from allotment.llm import chat, main_text, neighbours, urls
from allotment.llm.labelled_pages import labelled
from allotment.llm.queries import ORACLES, QUERIES, RULES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    from check import compare
    assert compare(QUERIES[name](spark, FOLDER), ORACLES[name], con) == "ok"


def test_escape_is_reversible():
    for text in ["", "\\", "a\\b\\\\", "</s>[INST] ok [/INST]", "<|turn|><|turn|>", "<<SYS>><</SYS>>\\<s>", "[\\INST]", "<|end|>\n<|end|>", "é\\東<|text|>"]:
        coded = chat.escape(text)
        assert chat.unescape(coded) == text and not any(c in coded for c in chat.CONTROLS)


def test_layouts(spark):
    said = [("user", "hi"), ("assistant", "yo")]
    records = [{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
               {"prompt": "hi", "completion": "yo"}, {"instruction": "hi", "input": "", "output": "yo", "id": 3}, {"question": "hi", "answer": "yo"}, {"system": None, "prompt": "hi", "response": "yo"}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(6, None), (7, "{"), (8, '{"a": 1}'), (9, "[1]")]
    got = chat.turns_of_records(spark.createDataFrame(rows, "k long, r string"), "k", "r").collect()
    for i in range(6):
        assert [(r.role, r.text) for r in sorted((r for r in got if r.conv_id == i), key=lambda r: r.turn)] == said and all(r.layout for r in got if r.conv_id == i)
    assert [(r.layout, r.turn) for r in got if r.conv_id > 5] == [(None, None)] * 4
    table = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [(r.role, r.text) for r in chat.turns_of_table(table).orderBy("turn").collect()] == said
    flat = spark.createDataFrame([(1, "hi", "", "yo")], "conv_id long, instruction string, input string, output string")
    assert [(r.role, r.text) for r in chat.turns_of_table(flat).orderBy("turn").collect()] == said
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([(1, 2)], "conv_id long, b long"))


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "y" * 100_000), (1, 1, "assistant", "y" * 100_000), (None, None, "assistant", "z"), (2, 5, "", "")]
    table = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.turns_of_table(table))).collect()}
    said = "".join(f"{r}\n{t}\n" for r, t in [("user", ""), ("", "x"), ("assistant", "y" * 100_000), ("assistant", "y" * 100_000)])
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and (got[1].n_turns, got[1].loss_chars) == (4, 200_000)
    assert got[None].loss_chars == 1 and got[2].n_turns == 1
    assert chat.read_back(chat.formatted(chat.turns_of_table(table.limit(0)))).count() == 0


def test_pages_held_out():
    weights, pair = main_text.model()
    wrong = total = 0
    for page, wanted in labelled(150, seed=9):
        found = main_text.blocks(page)
        got = main_text.viterbi(np.array([weights[on].sum(axis=0) for on in main_text.active(found)]), pair)
        wrong += sum(label != (b.text in wanted) for b, label in zip(found, got))
        total += len(found)
    assert wrong < 0.01 * total


def test_viterbi_brute_force():
    from itertools import product
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        s, p = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda y: sum(s[i, c] for i, c in enumerate(y)) + sum(p[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(main_text.viterbi(s, p)) == max(product((0, 1), repeat=n), key=value)


def test_pages_odd_rows(spark):
    article = "<article><h1>A title</h1><p>One &amp; two&nbsp;three.\n Four.</p><p><b>Five six seven.<br><p>Eight nine ten, eleven.</article>"
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<<<>><p"), (4, "u", f"<nav><a href=/>x</a></nav>{article}<footer>&copy; x</footer>"), (4, "u", "<script>never ends"), (None, None, "<div " * 2000)]
    table = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, text string")
    got = main_text.main_texts(table, ["page_id", "url"]).collect()
    assert [r.text for r in got][:2] == ["", ""] and len(got) == 6
    assert got[3].text == "A title\nOne & two three. Four.\nFive six seven.\nEight nine ten, eleven."
    assert main_text.main_texts(table.limit(0), ["page_id"]).count() == 0


def brute_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    return max(fits)[2:][::-1] if fits else (None, "allow")


def test_url_rules_brute_force(spark):
    rng = np.random.default_rng(3)
    labels, parts = ["a", "b", "org", "com", "a-b"], ["", "/", "/x", "/x/y", "/z"]
    host = lambda: ".".join(rng.choice(labels, rng.integers(1, 5)))
    rules = [(host(), str(rng.choice(parts)), str(rng.choice(["allow", "block"]))) for _ in range(60)]
    rows = [(i, f"http://{host()}{rng.choice(parts)}{rng.choice(['', '?q=/x', '#f'])}") for i in range(600)] + [(i, "http://A.ORG/x") for i in range(600, 1200)]
    table = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judged(table, spark.createDataFrame(rules, "host string, path string, verdict string"), ["page_id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        rule, verdict = brute_rule(r.host, r.path, rules)
        assert (r.rule, r.verdict) == (rule, verdict)


def test_url_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://X.Example.ORG/en/1?a"), (5, "HTTP://X.Example.ORG/en/1?a"), (None, "a://com/de/#"), (6, "http://org" + "/x" * 50_000)]
    table = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, host string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = urls.judged(table, rules, ["page_id"]).collect()
    assert sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in got if r.page_id != 6) == sorted(
        [(0, "com", "com/de/", "block"), (4, "", None, "allow"), *[(5, "x.example.org", "example.org/en/1", "block")] * 2, *[(i, "", None, "allow") for i in (1, 2, 3)]])
    assert len(got) == 8 and [(r.host, r.path, r.verdict) for r in got if r.page_id == 6] == [("org", "/x" * 50_000, "allow")]
    assert urls.judged(table.limit(0), rules, ["page_id"]).count() == 0 and urls.judged(table, rules.limit(0), ["page_id"]).filter("rule is not null").count() == 0


def nearest_by_force(ids, vectors, query, k=10):
    own = ids.tolist().index(query)
    d = np.sqrt(((vectors - vectors[own]) ** 2).sum(1))
    d[ids == query] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order if np.isfinite(d[i])]


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.toPandas()
    ids, vectors = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got, hit, total = neighbours.neighbours(table).toPandas(), 0, 0
    for q in ids[ids % 100 == 0]:
        wanted = nearest_by_force(ids, vectors, q)
        found = got[got.query_id == q].sort_values("rank")
        assert len(found) == 10 and found.score.is_monotonic_increasing
        hit += len({i for i, _ in wanted} & set(found.vec_id))
        total += len(wanted)
    assert hit >= 0.9 * total


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 2.0]),
            (100, [4.0, 6.0]), (100, [4.0, 6.0]), (9, [])]
    table = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<double>, list string")
    got = [tuple(r) for r in neighbours.neighbours(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 5.0), (100, 1, 0, 5.0), (100, 2, 1, 5.0), (100, 3, 2, 5.0)]
    assert neighbours.neighbours(table.limit(0)).count() == 0


@pytest.mark.parametrize("copy", [1, 3, 8, 11])
def test_neighbours_of_many_equal_rows(spark, copy):
    rows = spark.range(60_000).select(F.lit(copy).alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    rows = rows.unionByName(spark.createDataFrame([(i, [float(i + 1), 2.0]) for i in (0, 5, 6, 7, 9)], "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in neighbours.neighbours(rows).orderBy("rank").collect()]
    assert [r[2] for r in got] == [copy, 5, 6, 7, 9] and got[0] == (0, 1, copy, 0.0)


def test_rules_of_many_equal_rows(spark):
    rows = spark.range(100_000).select(F.lit(7).alias("page_id"), F.lit("http://a.example.org/es/1").alias("url"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert [tuple(r) for r in urls.judged(rows, rules, ["page_id"]).groupBy("rule", "verdict").count().collect()] == [("example.org/es/", "block", 100_000)]


def test_layout_of_a_table_with_known_names(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi", "p", "s"), (1, 1, "assistant", "ho", "p", "s")], "conv_id long, turn long, role string, text string, prompt string, system string")
    assert sorted(tuple(r)[1:] for r in chat.turns_of_table(turns).collect()) == [(0, "user", "hi"), (1, "assistant", "ho")]
    pairs = spark.createDataFrame([(1, "a", "b", "c")], "conv_id long, prompt string, completion string, response string")
    with pytest.raises(ValueError):  # two layouts fit as well
        chat.turns_of_table(pairs)


def test_text_of_formulas_and_fallbacks():
    page = ("<body><nav><a href=/a/>Home</a></nav><article><p>The energy of the body at rest is <math><mi>E</mi><mspace/></math> as it was said in the paper.</p>"
            "<p>The film <video src='x'>shows how the old mill was built by the people of the town</video> in spring.</p></article></body>")
    texts = [b.text for b in main_text.blocks(page)]
    assert "The energy of the body at rest is E as it was said in the paper." in texts
    assert any("shows how the old mill" in t for t in texts)


def test_graph_finds_nearest():
    rng = np.random.default_rng(0)
    centroids, queries = rng.normal(size=(300, 16)), rng.normal(size=(50, 16))
    found, _ = neighbours.Graph.build(centroids).nearest(queries, 64)
    exact = neighbours.squared(queries, centroids).argsort(1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(found.tolist(), exact.tolist())]) > 0.95


def test_lists_are_balanced():
    sample = np.random.default_rng(0).normal(size=(4000, 8))
    owner = neighbours.squared(sample, neighbours.balanced_centroids(sample, 20)).argmin(1)
    assert np.bincount(owner, minlength=20).max() < 3 * 200
