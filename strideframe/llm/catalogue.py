"""The registered queries of this package and their check SQL."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import (
    bpe, decontamination, language, nearest, packing, passages, personal, secrets, similar, spellings, token_counts, token_files,
    whitening,
)
from strideframe.llm.stages import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.digest(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op2_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return secrets.scan(docs, secrets.fit(docs))


def op3_similar(spark: SparkSession, sf: str) -> DataFrame:
    return similar.digest(documents(spark, sf))


def op4_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.digest(documents(spark, sf))


def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.digest(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), 2)


def op6_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


def op8_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal.digest(documents(spark, sf))


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.digest(documents(spark, sf))


def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digest(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.digest(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op12_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digest(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), 1)


def op13_spellings(spark: SparkSession, sf: str) -> DataFrame:
    return spellings.digest(documents(spark, sf))


_QUERIES = (
    op1_decontamination, op2_secrets, op3_similar, op4_passages, op5_token_files, op6_nearest, op7_token_counts, op8_personal_data,
    op9_language, op10_byte_bpe, op11_whitening, op12_packing, op13_spellings,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.SQL, "op3_similar": similar.SQL, "op4_passages": passages.SQL, "op6_nearest": nearest.SQL}
