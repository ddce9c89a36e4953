"""The registered queries of these operators; each takes (spark, folder) and reads its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from allotment.llm import chat, decontam, langid, main_text as main_text_, near_dedup, neighbours, packing, quality, repeats, runs, spelling, toxicity, urls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_near_duplicates")
def near_duplicate_components(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents")).drop("row")


@query("op3_repeated_lines")
def repeated_lines(spark, folder):
    found = repeats.repeated_passages(table(spark, folder, "documents"))
    return found.select("doc_id", "start", "end", "words", F.col("first_id").alias("first_doc_id"), "copies")


@query("op6_contamination")
def benchmark_contamination(spark, folder):
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op8_language")
def language(spark, folder):
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.learned(docs))


@query("op9_packing")
def packing_pieces(spark, folder):
    found = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.drop("padded")


CONTROL_STRINGS = " + ".join(
    f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in chat.CONTROLS)


@query("op5_chat_format", f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|><|text|><|end|>') + length(r) + length(t) + length(t) - length(replace(t, chr(92), ''))
      + {CONTROL_STRINGS})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""")
def chat_format(spark, folder):
    said = "</s>[INST] ok [/INST]"
    own = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)").withColumn("text", F.lit(said))
    turns = chat.turns_of_table(table(spark, folder, "conversations")).unionByName(chat.turns_of_table(own))
    return chat.read_back(chat.formatted(turns))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op10_url_rules", """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(a, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(a, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged""")
def url_rules(spark, folder):
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS t(host, path, verdict)")
    return urls.judged(table(spark, folder, "pages"), rules, ["page_id"])


@query("op7_main_text")
def main_text(spark, folder):
    found = main_text_.main_texts(table(spark, folder, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


#: Order of the chain: what is hard to read, what is toxic, and what is both.
CATEGORIES = ["low_quality", "toxic", "toxic_low_quality"]


@query("op2_toxicity")
def toxicity_chain(spark, folder):
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select(
        "doc_id", (F.col("quality") == 0).alias("low_quality"), (F.col("toxic") == 1).alias("toxic"),
        ((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("toxic_low_quality"))
    return toxicity.judged(docs, toxicity.fit(docs, labels, CATEGORIES), CATEGORIES, ["doc_id"])


@query("op4_nearest")
def nearest(spark, folder):
    return neighbours.neighbours(table(spark, folder, "embeddings"))


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


RULE_SQL = ", ".join(f"CASE WHEN {' OR '.join([f'{r.measure} * 1000 < {per} * {r.least}'] * (r.least is not None) + [f'{r.measure} * 1000 > {per} * {r.most}'] * (r.most is not None))} "
                     f"THEN '{r.name}' END" for r in quality.RULES for per in ["1" if r.per == "one" else r.per])


@query("op12_quality_rules", rf"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines,
    row_number() OVER () AS row_id
  FROM documents),
windows AS (
  SELECT row_id, i AS place, array_to_string(list_slice(words, i, i + {quality.WINDOW - 1}), ' ') AS said
  FROM parts, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS r(i)),
again AS (
  SELECT row_id, place FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, said) > 1),
covered AS (
  SELECT row_id, sum(least({quality.WINDOW}, coalesce(place - before, {quality.WINDOW}))) AS n
  FROM (SELECT row_id, place, lag(place) OVER (PARTITION BY row_id ORDER BY place) AS before FROM again) GROUP BY row_id),
measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda w: regexp_replace(translate(w, '{quality.UPPER}', '{quality.LOWER}'), '[.,;:!?"''()]', '', 'g')
      IN ({_quoted(quality.STOP_WORDS)})))::BIGINT AS n_stop_words,
    len(lines)::BIGINT AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ 	-]*[-*•]')))::BIGINT AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ 	-]*$')))::BIGINT AS n_ellipsis_lines
  FROM parts LEFT JOIN covered USING (row_id)),
failing AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', {RULE_SQL}) AS failed FROM measured)
SELECT doc_id, {", ".join(quality.MEASURES)}, base_failed, failed, NOT base_failed AND failed = '' AS kept FROM failing""")
def quality_rules(spark, folder):
    return quality.judged(table(spark, folder, "documents"))


@query("op11_periodic_runs")
def periodic_runs(spark, folder):
    found = runs.periodic_runs(table(spark, folder, "documents"), rewrite=runs.planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_spelling_variants")
def spelling_variants(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"), every=31)
