"""Corpus pipeline over ``documents``.

STAGES are applied in order; each reads what the one before it kept and
returns the columns of ``documents`` (the last one returns pieces):

1. quality: documents that the pairwise ranking rejects go;
2. exact_dedup: of equal texts the row with the largest doc_id stays;
3. near_dedup: of each group of near duplicates (five-word shingles,
   similarity 0.8 or more) the row with the smallest doc_id stays;
4. pii: personal data is replaced by its kind in brackets;
5. packing: texts become token pieces in sequences of 2048.

The ranking learns from all labelled documents, the trees of the redaction
from all documents that the stage is given (nothing is held out or sampled);
rows that a stage keeps keep their other columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import exact_dedup, near_dup, packing, pii, quality
from riskloom.llm.common import materialized, read_table, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_dup.drop_near_copies(docs, shingle=5, percent=80)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pii.redact(docs, pii.fit(docs, pii.Settings(max_documents=None, planted_documents=None)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("pii", redacted),
    ("packing", packed),
]

#: no SQL: ranking, sketches, trees and tokenizers; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
