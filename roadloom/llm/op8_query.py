"""Query op8: all documents scored by a Katz model of those whose crc32(doc_id) mod 7 is not 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.katz import score_documents


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out)
