"""Query op1: all documents in shards 0 to 39, and where a 41st shard would take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.hash_tree import Leaf, even_tree, grow, shard_by_tree


def op1_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tree = even_tree(40)
    return shard_by_tree(docs, tree, grow(tree, [Leaf(4, 20, 40)]))
