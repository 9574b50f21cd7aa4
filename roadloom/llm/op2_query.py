"""Query op2: all documents as bit-plane token files, read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.token_files import library_encoder, read_token_files, write_token_files


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoder = library_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return read_token_files(write_token_files(docs, encoder, end_id=0))
