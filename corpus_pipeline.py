"""A corpus from raw documents to packed token sequences: STAGES, run(spark, sf_dir) and ORACLE_SQL.

Every stage is written as Parquet in shared scratch space and read again as the next one's documents. Models are trained on the labelled rows
among the documents that the stage is given.

All stages take any columns beside doc_id and text and hand them on, whatever their names. Null and empty texts hold nothing toxic, get the quality score of no
difference, are like no other and stay; the last stage packs them as their closing id alone. Very long texts are read whole. Rows that repeat a
doc_id, or have none, are documents of their own everywhere; equal texts are near-duplicates, of which one row stays. Where a score is exactly at a
threshold, 0.5 counts as toxic and 0.3 as good. An empty table goes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import neardup, packing, pii, quality, toxicity
from seqloom.llm.common import delete, keep, noting, table
from seqloom.llm.queries import WORDS


def _kept(docs: DataFrame, score: Callable[[DataFrame], DataFrame], which: str) -> DataFrame:
    """The rows of ``docs`` for which ``which`` holds once they are scored; its columns may be named like a score."""
    plain = docs.toDF(*(c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)))
    return score(plain).where(which).select(*plain.columns).toDF(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; those without a sentence score 0."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: toxicity.score(d, model), "predicted = 0")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: quality.score(d, model), "predicted = 1")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near-duplicates; rows without an id of their own come last."""
    return neardup.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with entities and terms that disclose them replaced, and n_chars to match."""
    clean = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its place in a sequence of at most 2048 ids."""
    return packing.pack_documents(docs, WORDS, 2048)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_quality),
    ("minhash_near_dedup", one_of_each_group),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]

#: Trained models, sketches and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote besides its result, and the result once the next is written, is deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with noting() as written:
            docs = keep(stage(spark, docs, sf_dir))
        delete(spark, [*before, *written[:-1]])
        before = written[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
