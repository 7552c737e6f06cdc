"""The corpus pipeline: language, quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  Its result is
written as Parquet and read again as the next stage's docs, which cuts lineage between stages.  All
but the last return the columns of ``documents``.  Null ids and repeated rows are rows like any other;
null, empty and letterless texts leave with the first stage; very long texts are taken whole; ties are
those of the operators; an empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact_dedup, language_id, packing, quality, similar_texts
from quillspark.llm.common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learnt language stay; texts without a letter or foreign to all of them go."""
    return language_id.accepted(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality classifier predicts as good stay."""
    return quality.good_rows(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that are similar in five-word shingles (0.8 or more) the row with the smallest id stays."""
    return similar_texts.near_deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining texts with their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language),
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("packing", pack),
]

#: Models and tokenizers can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
