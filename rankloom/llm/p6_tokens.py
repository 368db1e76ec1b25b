"""Problem 6: token ids of the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.tokenizer import VOCABULARY, token_ids


def encoded_corpus(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``ids``: ids of each text without special tokens; [] for an empty and for a null text."""
    return token_ids(documents, "doc_id", "text", vocabulary).select(F.col("id").alias("doc_id"), "ids")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
