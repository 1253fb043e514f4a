"""A corpus pipeline of five training-data operators.

Language identification drops documents whose language isn't identified, near-dedup keeps one document of each class,
decontamination drops or cuts what holds benchmark items, personal data is masked, and what is left is encoded.
Each stage takes all that the one before it kept and returns the columns of documents; the last returns the ids.

Defined results, in every stage: null and empty texts are rejected by the first stage, as nothing in them names a
language; very long texts are handled whole; of equal rows the second stage keeps one; ties are settled as the operators
say; an empty table gives no rows; further columns, whatever their names, are handed on unchanged up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontam, langid, near_dup, pii
from millrace.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs


#: Word alignment, language evidence and byte-pair merges are not SQL; tests hold run() against plain Python.
ORACLE_SQL = None
