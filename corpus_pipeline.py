"""From raw documents to token ids: language, near duplicates, benchmark passages, secrets, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and is written as Parquet
before the next one reads it. All but the last return the columns of ``docs``.

Defined cases: an empty table gives no row; NULL, empty and letterless texts go in the first stage; rows with a NULL id are
documents like others, but teach no language; repeated rows and equal texts are near duplicates of each other, of which
the smallest id stays (NULL ids count as largest); columns of any other name travel along.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import bpe, decontamination, language, secrets, similar
from strideframe.llm.stages import Scratch, documents, small_batches

#: Language models and random forests have no SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays open; only the former if no language is labelled."""
    small_batches(spark)
    return language.identified(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of every component of similar ones."""
    small_batches(spark)
    return similar.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    small_batches(spark)
    return decontamination.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows. No document is dropped."""
    small_batches(spark)
    return secrets.redacted(docs, secrets.fit(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of the whole text."""
    small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
