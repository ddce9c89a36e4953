"""Operators over documents against brute force in plain Python, and on odd rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_rows import FOLDER, WORDS, no_docs, odd_docs  # noqa: F401

import corpus_pipeline
from allotment.llm import decontam, langid, near_dedup, packing, repeats, toxicity
from allotment.llm.queries import CATEGORIES, QUERIES

SMALL = {i: i + 32 for i in range(65, 91)}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(SMALL))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked_components(texts, percent=75):
    """Position of the smallest linked text for each text, by comparing all that share a shingle."""
    sets = [shingle_set(t) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for held in holders.values():
        for n, i in enumerate(held):
            for j in held[:n]:
                shared[j, i] += 1
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], sets


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return dict(docs.select("doc_id", "text").orderBy("doc_id").toPandas().itertuples(index=False))


def test_near_duplicates_brute_force(docs, texts):
    ids = list(texts)
    roots, sets = linked_components(list(texts.values()))
    for r in near_dedup.near_duplicates(docs).collect():
        i = ids.index(r.doc_id)
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), ids[roots[i]], roots[i] == i)


def test_near_duplicates_in_chains_and_crowds(spark):
    """Edited copies of one original that are often too far from each other, and a chain whose ends are far apart."""
    rng = np.random.default_rng(1)
    base, rows = [f"b{i}" for i in range(150)], []
    for k in range(120):
        words = list(base)
        for p in rng.choice(150, rng.integers(0, 12), replace=False):
            words[p] = f"e{k}x{p}"
        rows.append(" ".join(words))
    chain = [f"c{i}" for i in range(200)]
    rows += [" ".join(chain[4 * k:4 * k + 120]) for k in range(20)]
    roots, sets = linked_components(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(roots))


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count() and near_dedup.near_duplicates(no_docs).count() == 0
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[4] == {(4, True)} and by[5] == {(4, False), (5, True)} and by[10] == {(4, False)} and by[2] == {(2, True)} and by[12] == {(11, False)}
    assert by[None] == {(4, False), (None, True)}
    kept = near_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({(r.doc_id, r.row) for r in got if r.kept})


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    shared, own = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, (2, 100)).astype(np.uint64)
    a, b = (np.unique(np.concatenate([shared, o])) for o in own)
    x, y = near_dedup.odd_sketches(near_dedup.samples([a, b]))
    bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
    assert abs(bits - near_dedup.most_bits(0.8)) < 60


def contaminated(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(SMALL))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k:k + 10])].add(item)
    out = []
    for text in texts:
        w, hit, found = word.findall((text or "").translate(SMALL)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in names if i is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("automaton_bytes", [decontam.AUTOMATON_BYTES, 2000])
def test_contamination_brute_force(spark, docs, texts, monkeypatch, automaton_bytes):
    monkeypatch.setattr(decontam, "AUTOMATON_BYTES", automaton_bytes)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    wanted = dict(zip(texts, contaminated(texts.values(), [tuple(r) for r in bench.select("item_id", "text").collect()])))
    got = decontam.contamination(docs, bench).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, list(r["items"])) == wanted[r.doc_id]
        spans = " ".join(texts[r.doc_id][s.start:s.end] for s in r.spans)
        assert contaminated([spans], [])[0][0] == r.n_hit


def test_contamination_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None, "e"), (2, "ONE", "e"), (2, "one", "e"), (None, "words here", "e"), (3, "東京 résumé", "e")], "item_id long, text string, doc_id string")
    got = [(r.n_words, r.n_hit, list(r["items"])) for r in decontam.contamination(odd_docs, items).collect()]
    assert got == contaminated([r.text for r in odd_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert decontam.contamination(no_docs, items).count() == 0
    assert decontam.contamination(odd_docs, items.limit(0)).filter("n_hit > 0").count() == 0


def brute_units(text):
    """Sentences of lines as (start, end, key) for those long enough to be told apart."""
    out = []
    for line in re.finditer(r"[^\n]+", text or ""):
        words = [(m.start() + line.start(), m.end() + line.start()) for m in re.finditer(r"[^\x20\x09-\x0d]+", line.group())]
        units, first = [], 0
        for i, (_, e) in enumerate(words):
            if i == len(words) - 1 or text[e - 1] in ".!?":
                units.append((first, i + 1))
                first = i + 1
        for n, (s, e) in enumerate(units):
            a, b = n, n
            while units[b][1] - units[a][0] < repeats.MIN_WORDS and a > 0:
                a -= 1
            while units[b][1] - units[a][0] < repeats.MIN_WORDS and b < len(units) - 1:
                b += 1
            size = units[b][1] - units[a][0]
            if size >= repeats.MIN_WORDS or (size >= repeats.MIN_LINE_WORDS and a == 0 and b == len(units) - 1):
                key = (s - units[a][0], e - s, *(text[x:y].translate(SMALL) for x, y in words[units[a][0]:units[b][1]]))
                out.append((words[s][0], words[e - 1][1], key))
    return out


def test_repeats_brute_force(docs, texts):
    first, wanted = {}, set()
    for doc, text in texts.items():
        for start, end, key in brute_units(text):
            if key in first:
                wanted.add((doc, start, end, first[key]))
            else:
                first[key] = doc
    assert {(r.doc_id, r.start, r.end, r.first_id) for r in repeats.repeated_units(docs).collect()} == wanted


def test_repeats_odd_rows(odd_docs, no_docs):
    found = repeats.repeated_units(odd_docs)
    assert {r.doc_id for r in found.collect()} == {5, None, 8}
    left = repeats.remove_units(odd_docs, found)
    assert left.columns == odd_docs.columns
    rows = {(r.doc_id, r.text) for r in left.collect()}
    assert (4, " ".join(WORDS * 3)) in rows and (8, "Été À 東京 résumé.") in rows and not any(i == 5 and t.startswith("the red") for i, t in rows if t)
    assert repeats.repeated_units(no_docs).count() == 0 and repeats.remove_units(no_docs, repeats.repeated_units(no_docs)).count() == 0


def test_repeated_passages_inside_sentences(spark):
    """60 words in the middle of sentences that share nothing else, and a run that only overlaps itself."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(k, " ".join([f"a{k}x{i}" for i in range(20 + k)] + passage + [f"b{k}x{i}" for i in range(30)]) + ".") for k in range(4)]
    rows += [(9, " ".join(f"c{i}" for i in range(200))), (10, "so " * 100)]
    found, words = defaultdict(set), {k: [m.span() for m in re.finditer(r"\S+", t)] for k, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in repeats.repeated_passages(docs).collect():
        found[r.doc_id] |= {i for i, (a, b) in enumerate(words[r.doc_id]) if r.start <= a and b <= r.end}
        assert r.doc_id == r.first_id == 10 or (r.first_id == 0 and r.words >= repeats.MIN_WORDS)
    assert set(found) == {1, 2, 3, 10} and 0 not in found[10]
    for k in (1, 2, 3):
        least, most = 20 + k, 80 + k
        assert found[k] == set(range(min(found[k]), max(found[k]) + 1)) and least <= min(found[k]) < least + repeats.REACH and most - repeats.REACH < max(found[k]) + 1 <= most


@pytest.mark.parametrize("least", [1, repeats.LEAST_WORDS])
def test_passages_are_whole(spark, least):
    """Every word that a repeated unit or stretch covers, joined word by word in plain Python."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts, covered, first_id = dict(docs.select("doc_id", "text").collect()), defaultdict(set), {}
    for r in repeats._repeated(docs, "doc_id", "text", True).collect():
        covered[r.id] |= set(range(r["first"], r.after))
        for w in range(r["first"], r.after):
            first_id[r.id, w] = min(r.first_id, first_id.get((r.id, w), r.first_id))
    wanted = set()
    for d, seen in covered.items():
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", texts[d])]
        for w in sorted(seen):
            if w - 1 not in seen:
                last = next(x for x in range(w, len(spans) + 1) if x not in seen)
                if last - w >= least:
                    wanted.add((d, spans[w][0], spans[last - 1][1], last - w, min(first_id[d, x] for x in range(w, last))))
    got = [(r.doc_id, r.start, r.end, r.words, r.first_id) for r in repeats.repeated_passages(docs, least=least).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len({r[0] for r in got}) > 20


def test_repeats_in_scripts_without_spaces(spark):
    han = lambda seed, n: "".join(chr(0x4E00 + int(c)) for c in np.random.default_rng(seed).integers(0, 9000, n))
    thai = "".join(chr(0x0E01 + int(c)) for c in np.random.default_rng(3).integers(0, 46, 60))
    hindi = " ".join(f"शब्द{i}" for i in range(9)) + "।"
    long_line, passage = "x" * 30 + " " + "y" * 30, han(4, 150)
    rows = [(1, han(5, 50) + "。" + han(6, 45) + "！"), (2, han(7, 50) + "。" + han(6, 45) + "！" + han(8, 50)), (3, thai), (4, "a\n" + thai),
            (5, hindi + " " + hindi.replace("द", "ग")), (6, "और " * 9 + "। " + hindi), (7, long_line), (8, "b\n" + long_line),
            (9, han(10, 60) + passage + han(11, 70)), (10, han(12, 80) + passage + han(13, 60)), (11, han(14, 15) + "。"), (12, han(14, 15) + "。")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, dict(rows)[r.doc_id][r.start:r.end]) for r in repeats.repeated_units(docs).collect()}
    assert found == {(2, han(6, 45) + "！"), (4, thai), (6, hindi), (8, long_line)}
    inside = [r for r in repeats.repeated_passages(docs).collect() if r.doc_id == 10]
    assert min(r.start for r in inside) in range(80, 80 + repeats.REACH) and max(r.end for r in inside) in range(231 - repeats.REACH, 231)
    assert {i for r in inside for i in range(r.start, r.end)} == set(range(min(r.start for r in inside), max(r.end for r in inside)))


def test_without():
    assert repeats.without("One two. Three four. Five.", [(9, 20)]) == "One two. Five."
    assert repeats.without("a b\nc d\ne f", [(4, 7)]) == "a b\ne f"
    assert repeats.without("a b", [(0, 3)]) == ""


def test_language_held_out(docs):
    network = langid.learned(docs)
    got = langid.identify(docs, network).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    assert set(got.doc_id) == {i for i in docs.toPandas().doc_id if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_odd_rows(docs, odd_docs, no_docs):
    network = langid.learned(docs)
    got = langid.identify(odd_docs, network).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 9)} == {"und"} and not any(r.held_out for r in got if r.doc_id is None)
    assert langid.learned(no_docs) is None and {r.lang_pred for r in langid.identify(odd_docs, None).collect()} == {"und"}
    assert langid.identify(no_docs, network).count() == 0


def check_packing(rows, wanted):
    """wanted: (doc_id, ids) in any order; each id lies in exactly one piece."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.sequence_id].append(r)
    for group in pieces.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == [sum(x.length for x in group[:i]) for i in range(len(group))]
        assert sum(r.length for r in group) <= packing.LENGTH
    of_doc = defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
    for doc, lists in wanted.items():
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in of_doc.pop(doc))
        total = 0
        if len(lists) == 1:
            ids = np.array(lists[0], dtype="<u4")
            for start, length, crc, count in got:
                assert start == total and count == len(ids) and crc == zlib.crc32(ids[start:start + length].tobytes())
                total += length
        else:
            total = sum(g[1] for g in got)
        assert total == sum(map(len, lists))
    assert not of_doc
    filled = sum(sum(r.length for r in g) for g in pieces.values())
    return sum(packing.padding(sum(r.length for r in g)) for g in pieces.values()) / max(1, filled)


def tokens(texts):
    from tokenizers import Tokenizer
    made = Tokenizer.from_file(TOKENIZER)
    return [[*e.ids, 2] for e in made.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing_round_trip(docs, texts):
    wanted = {d: [ids] for d, ids in zip(texts, tokens(texts.values()))}
    assert check_packing(packing.pack(docs, TOKENIZER).collect(), wanted) < 0.01


def test_packing_odd_rows(odd_docs, no_docs):
    wanted = defaultdict(list)
    rows = odd_docs.collect()
    for r, ids in zip(rows, tokens([r.text for r in rows])):
        wanted[r.doc_id].append(ids)
    check_packing(packing.pack(odd_docs, TOKENIZER).collect(), wanted)
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def test_encoder_is_exact():
    import pyarrow as pa
    odd = ["don't stop. It's 3.14, isn't it?", "<|ENDOFTEXT|> a<|endoftext|>b. ", "É.e\u0301, n\u0303. ÷. ×!", "A\u00a0b\u2003c\x1cd\x85e", "we'll—,they've", "\u0301x ..., ?!", "東京。Tokyo.", "a\r\nb\tc", "ﬁ.ß,ẞ", ""]
    ids, counts, _ = packing.Encoder(TOKENIZER).encode(pa.array(odd))
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, wanted in enumerate(tokens(odd)):
        assert ids[at[i]:at[i + 1]].tolist() == wanted[:-1], odd[i]


def test_best_cuts_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        ends = np.unique(rng.integers(1, 3000, 40))
        ends = np.append(ends, ends[-1] + 500)
        costs = rng.integers(0, 30, len(ends))
        at, value = [0, *ends.tolist()], {0: 0}
        length = 1024
        if np.diff(at).max() > length:
            continue
        for p, c in zip(ends.tolist(), costs.tolist()):
            value[p] = c + min(value[q] + (0 if (p - q) & (p - q - 1) == 0 and p - q >= packing.SHORTEST else length - p + q) for q in value if p - q <= length)
        cuts = packing.best_cuts(ends, costs, length)
        cost_of, got, last = dict(zip(ends.tolist(), costs.tolist())), 0, 0
        for p in cuts:
            n = p - last
            got += cost_of[p] + (0 if n & (n - 1) == 0 and n >= packing.SHORTEST else length - n)
            last = p
        assert got == value[at[-1]]


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    marked = labels.select("doc_id", (labels.quality == 0).alias("low_quality"), (labels.toxic == 1).alias("toxic"), ((labels.toxic == 1) & (labels.quality == 0)).alias("toxic_low_quality"))
    chain = toxicity.fit(docs, marked.filter("doc_id % 3 != 0"), CATEGORIES)
    assert len(chain) == 3 and [len(m.earlier) for m in chain] == [0, 1, 2]
    unseen = marked.filter("doc_id % 3 = 0").withColumnsRenamed({c: f"true_{c}" for c in CATEGORIES})
    got = toxicity.judged(docs, chain, CATEGORIES, ["doc_id"]).join(unseen, "doc_id").toPandas()
    found, right = got.toxic & got.true_toxic, got.true_toxic
    assert found.sum() / right.sum() > 0.85 and found.sum() / got.toxic.sum() > 0.9


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (99, 0), (11, None), (8, 0), (9, 0)], "doc_id long, toxic int")
    chain = toxicity.fit(odd_docs, labels, ["toxic"])
    got = toxicity.judged(odd_docs, chain, ["toxic"], ["doc_id"]).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.toxic_score <= 1 for r in got)
    assert toxicity.fit(no_docs, labels, ["toxic"]) is None and toxicity.fit(odd_docs, labels.limit(0), ["toxic"]) is None
    assert {r.toxic for r in toxicity.judged(odd_docs, None, ["toxic"], ["doc_id"]).collect()} == {False}


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on the smallest tables; what it should keep stays."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, FOLDER)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    rows = kept.orderBy("doc_id").collect()
    roots, _ = linked_components([r.text for r in rows])
    unique = corpus_pipeline.near_duplicates(spark, kept, FOLDER)
    assert sorted(r.doc_id for r in unique.collect()) == [r.doc_id for i, r in enumerate(rows) if roots[i] == i]
    cut = corpus_pipeline.repeated_lines(spark, unique, FOLDER)
    assert cut.columns == docs.columns and repeats.repeated_units(cut).filter(f"words >= {repeats.LEAST_WORDS}").count() == 0
    clean = corpus_pipeline.decontamination(spark, cut, FOLDER)
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = cut.collect()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r, (_, hit, _) in zip(rows, contaminated([r.text for r in rows], items)) if not hit)
    rows = clean.collect()
    wanted = {r.doc_id: [ids] for r, ids in zip(rows, tokens([r.text for r in rows]))}
    assert check_packing(corpus_pipeline.packed(spark, clean, FOLDER).collect(), wanted) < 0.02
    assert check_packing(corpus_pipeline.run(spark, FOLDER).collect(), wanted) < 0.02


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, odd_docs, no_docs, stage):
    run = corpus_pipeline.STAGES[stage][1]
    columns = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (columns, columns.limit(0)):
        got = run(spark, rows, FOLDER)
        got.collect()
        assert stage == 4 or got.columns == rows.columns


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_sketch_limit_loses_no_pairs_at_the_limit():
    """Pairs of similarity exactly 0.75 with ideal samples: the bits that differ stay below the limit."""
    rng = np.random.default_rng(5)
    limit, worst = near_dedup.most_bits(0.665), 0
    for _ in range(40):
        minima = rng.integers(0, 1 << 32, size=(1000, near_dedup.SAMPLES), dtype=np.uint32)
        other = np.where(rng.random(minima.shape) < 0.75, minima, rng.integers(0, 1 << 32, size=minima.shape, dtype=np.uint32))
        bits = np.bitwise_count((near_dedup.odd_sketches(minima) ^ near_dedup.odd_sketches(other)).view(np.uint64)).sum(axis=1)
        worst = max(worst, int(bits.max()))
    assert worst < limit


def test_language_of_many_equal_rows(spark):
    from pyspark.sql import functions as F
    rows = spark.range(60_000).select(F.lit(1).alias("doc_id"), F.lit("the old mill by the sea").alias("text"), F.lit("en").alias("lang"))
    empty = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("123").alias("text"), F.lit("fr").alias("lang"))
    few = spark.range(300).select((F.col("id") + 100_000).alias("doc_id"), F.concat(F.lit("der alte Turm "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    network = langid.fit(rows.unionByName(empty).unionByName(few))
    assert network is not None and set(network.langs) == {"en", "de"}


def test_units_that_may_repeat(spark):
    rng = np.random.default_rng(1)
    d1 = rng.integers(-(1 << 63), 1 << 63, size=5000)
    table = repeats.bitmap(spark.createDataFrame([(int(x),) for x in d1], "d1 long"))
    assert repeats.may_repeat(table, d1.view(np.uint64)).all()
    assert repeats.may_repeat(table, rng.integers(-(1 << 63), 1 << 63, size=5000).view(np.uint64)).mean() < 0.01


def test_units_are_removed_in_one_branch(spark, odd_docs):
    found = repeats.repeated_passages(odd_docs, least=1)
    left = repeats.remove_units(odd_docs, found)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3  # the units, what joins them and the cut, each once
    assert left.columns == odd_docs.columns
    assert left.filter("text is null").count() == 2 and left.filter("doc_id = 9").count() == 1
