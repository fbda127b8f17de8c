"""From documents to packed training sequences: language ID, quality filter, near-duplicate removal, best-fit packing.

Every stage works on all rows that the one before it kept; run() writes each stage's result as Parquet into the shared
folder and reads it again. No stage is expressible in SQL (trained classifiers, sketches, a tokenizer), so ORACLE_SQL is
None and the tests hold run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import langid, minhash, packing, quality
from quarrylight.llm.common import read, saved
from quarrylight.llm.queries import language_model, quality_model, ready, tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a margin; those that the classifier rejects go."""
    ready(spark)
    return langid.keep_identified(docs, language_model(docs))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.3 or more)."""
    ready(spark)
    return quality.keep_good(docs, quality_model(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    ready(spark)
    return minhash.keep_first(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and offset."""
    ready(spark)
    return packing.pack(docs, tokenizer())


STAGES = [("language_id", language_id), ("quality", quality_filter), ("near_dedup", near_dedup), ("best_fit", best_fit)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
