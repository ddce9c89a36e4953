"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is a count, every rule a ratio of two of them in thousandths, so a verdict is integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BULLETS = "-*•"
STOPS = ".,;:!?\"'()"
WINDOW = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Frequent function words of English, German, French and Spanish, lower-cased.
STOP_WORDS = ("the of and to in is that it for was on are as with be at by this have from or an not but which "
              "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an er dem "
              "le la les de des et un une est que qui dans pour pas sur au avec il ce du en "
              "el los las y en que se del por con una su para al lo como más o").split()


class Rule(NamedTuple):
    """`measure` must lie between `least` and `most` thousandths of `per`; None leaves that side open."""

    name: str
    measure: str
    per: str
    least: int | None = None
    most: int | None = None


#: What a document must fulfil besides the base rules. `one` is the number 1.
RULES = (
    Rule("short_words", "word_chars", "n_words", least=2_000),
    Rule("long_words", "word_chars", "n_words", most=15_000),
    Rule("symbols", "n_symbols", "n_words", most=300),
    Rule("stop_words", "n_stop_words", "one", least=2_000),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=500),
    Rule("bullets", "n_bullet_lines", "n_lines", most=900),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", most=300),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur at least twice in the array, the first occurrence included.

    Windows (a power of two of words) are told by 64-bit hashes, each made of those of its halves, and sorted with their
    places only if one of them is there twice.
    """
    def doubled(hashes: Column, width: int) -> Column:
        if width == window:
            return F.slice(hashes, 1, F.size(hashes) - (window - 1))
        return let(F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + width))), lambda h: doubled(h, 2 * width))

    def covered(keys: Column) -> Column:
        def of(placed: Column) -> Column:
            again = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda j: placed[j]["key"].eqNullSafe(F.get(placed, j - 1)["key"])
                             | placed[j]["key"].eqNullSafe(F.get(placed, j + 1)["key"]))
            places = F.sort_array(F.transform(again, lambda j: placed[j]["at"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
            step = lambda s, x: F.struct(x.alias("last"), (s["total"] + F.least(F.lit(window), x - s["last"])).alias("total"))
            return F.aggregate(places, start, step, lambda s: s["total"])
        return let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at")))), of)

    def of_words(w: Column) -> Column:
        keys = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: doubled(h, 1))
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0)))
    return F.when(F.size(words) > window, let(words, of_words)).otherwise(F.lit(0))


def counted(text: Column, chars: str) -> Column:
    """How many characters of the text are among `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and the MEASURES of every whole text, as longs: built-in functions only, no shuffle.

    Words are runs of anything but ASCII white space, lines what line feeds part; a line counts if it has a word. A null
    or empty text has none. Repeated rows are measured each on its own, null ids too; other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    parts = docs.select(F.col(id_column).alias("id"), text.alias("text"),
                        F.array_remove(F.split(text, SPACE + "+"), "").alias("words"),
                        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"))
    words, lines = F.col("words"), F.col("lines")
    bare = lambda w: F.translate(w, UPPER + STOPS, LOWER)
    line = lambda c: F.btrim(c, F.lit(SPACES))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length("text") - counted(F.col("text"), SPACES),
        "n_symbols": counted(F.col("text"), SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: bare(w).isin(*STOP_WORDS))),
        "n_lines": F.size(lines),
        "n_bullet_lines": F.size(F.filter(lines, lambda c: F.substring(line(c), 1, 1).isin(*BULLETS))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda c: line(c).endswith("...") | line(c).endswith("…"))),
    }
    return parts.select("id", *[counts[name].cast("long").alias(name) for name in MEASURES])


def broken(rule: Rule) -> Column:
    measure, per = F.col(rule.measure) * 1000, F.lit(1) if rule.per == "one" else F.col(rule.per)
    sides = [measure < per * rule.least] * (rule.least is not None) + [measure > per * rule.most] * (rule.most is not None)
    return sides[0] | sides[1] if len(sides) == 2 else sides[0]


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, MEASURES, base_failed, kept and `failed` (names of the broken rules in their order, joined by commas).

    base_failed: fewer than 20 words, or more than three of ten words in repeated windows. kept: neither that nor a broken
    rule. A ratio to nothing (no lines, no words) breaks no upper limit. Odd rows: see `measures`.
    """
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    failed = F.concat_ws(",", *[F.when(broken(rule), F.lit(rule.name)) for rule in rules]) if rules else F.lit("")
    return measures(docs, id_column, text_column).select(
        F.col("id").alias(id_column), *MEASURES, base.alias("base_failed"), failed.alias("failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed") == ""))
