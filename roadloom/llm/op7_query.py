"""Query op7: byte-level BPE over all documents, with digests of ids and of the decoded bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.byte_bpe import codec, gathered


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_tokens and the sha256 of the decimal ids and of the bytes decoded from them.

    Null text is empty: no tokens, digests of nothing. Rows are independent,
    so ties and repeats keep their own rows; a long text is coded part by
    part, cut where a piece ends; an empty table gives none; other columns of
    `docs` are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        words = [b"%d " % i for i in range(len(own.lengths))]
        lengths = np.array([len(w) for w in words], np.int64)
        starts, blob = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.frombuffer(b"".join(words), np.uint8)
        for b in batches:
            for first, ids, counts in own.column(b.column(1)):
                of_ids, of_bytes, ends = [], [], np.cumsum(counts)
                for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                    of_ids.append(hashlib.sha256(gathered(ids[lo:hi], starts, lengths, blob)[:-1]).hexdigest())
                    of_bytes.append(hashlib.sha256(own.decode(ids[lo:hi])).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(counts)), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
