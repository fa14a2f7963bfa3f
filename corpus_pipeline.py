"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

1. ``language``: documents without any letter, which have no language, go; where ``lang`` is null,
   it becomes the predicted language.
2. ``line_dedup``: passages of several lines stay at their first place.
3. ``near_dedup``: of documents linked by five-word shingles at a similarity of 0.8, that with the
   smallest id stays; documents of which no letter or digit is left, since all their passages stand
   in earlier ones, go.
4. ``packing``: what is left becomes sequences of at most 2048 tokens.

Defined cases: rows without id stay in every stage; rows that repeat id and text, also without id,
count as one document from the third stage on; of rows that repeat an id with other texts, each is
judged by its own text; further columns are kept up to the third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.llm import language as language_id
from linewarden.llm import line_dedup as lines
from linewarden.llm import ngram_join, packing
from linewarden.llm.common import table, written
from linewarden.llm.queries import TOKENIZERS, WORD_BPE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, also where no row is labelled and so no language can be told.

    Those without ``lang`` get the predicted one.
    """
    scored = language_id.predict(docs, language_id.learn(docs), "_lettered").where("_lettered")
    if "lang" not in docs.columns:
        return scored.select(docs.columns)
    told = F.when(F.col("lang_pred") != language_id.UNKNOWN, F.col("lang_pred"))
    return scored.withColumn("lang", F.coalesce("lang", told)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; ``n_chars`` follows the text."""
    rest = lines.line_dedup(docs, lines.line_pairs)
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and none of those that lost all their text."""
    docs = docs.where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    found = ngram_join.near_duplicates(docs, words=5, percent=80, with_hash=True)
    gone = found.where("doc_id != component_id").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")
    ).distinct()
    hashed = docs.withColumn("_same", F.xxhash64("text"))
    rest = hashed.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_same") == F.col("_hash")), "left_anti")
    return rest.dropDuplicates(["doc_id", "_same"]).select(docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and offsets."""
    return packing.pack(docs, f"{TOKENIZERS}/{WORD_BPE}", with_ids=False)


STAGES = [
    ("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("packing", best_fit),
]

#: Neither learning nor tokenising can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
