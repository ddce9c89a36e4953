"""A corpus pipeline over `documents`: each stage works on what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from allotment.llm import decontam, langid, near_dedup, packing, repeats
from allotment.sources.shared import cut

#: A text whose best language has a lower mean probability is no text in a language that was learned.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rejects texts without a letter and texts whose language stays open."""
    judged = langid.predict(docs, langid.learned(docs), docs.columns)
    return judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup.deduplicated(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Cuts every passage of lines, sentences and stretches, 25 words or more, that an earlier document has; what has nothing left goes."""
    kept = repeats.remove_units(docs, repeats.repeated_passages(docs))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents with words of a benchmark window."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontam.contamination(docs, items, docs.columns).filter("n_hit = 0").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("substring dedup", repeated_lines),
          ("benchmark decontamination", decontamination), ("packing", packed)]

#: Trained models, links between near copies and tokenizers are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on `documents`; what each one keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, folder), "kept")
    return STAGES[-1][1](spark, docs, folder)
