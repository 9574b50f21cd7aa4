"""What operators leave on disk while later ones run."""

import os
import time
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from roadloom.llm.common import shared_dir, written


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def left_of(spark, before):
    """Shuffle files made since `before`; deleting them goes on beside the driver's own work."""
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_a_written_table_leaves_no_shuffle_files(spark):
    rows = spark.range(1000).selectExpr("id % 100 AS k", "id")
    summed, before = rows.groupBy("k").agg(F.sum("id").alias("n")), shuffle_files(spark)
    table = written(summed.join(rows.hint("merge"), "k"), "joined")
    assert not left_of(spark, before)
    assert table.count() == 1000 and {r.n for r in summed.collect()} == {r.n for r in table.collect()}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_cached_frame_may_be_written(spark):
    held = spark.range(1000).repartition(7, "id").cache()
    assert held.count() == 1000
    for _ in range(2):
        assert written(held.groupBy((F.col("id") % 10).alias("k")).count(), "counts").count() == 10
    held.unpersist()
    assert held.count() == 1000


def test_substring_dedup_has_freed_its_pairs_before_texts_are_cut(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage), (2, "more " + passage), (3, "other words")], "doc_id long, text string")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    tables = set(folder.iterdir()) if folder.exists() else set()
    before = shuffle_files(spark)
    left = corpus_pipeline.repeated_substrings(spark, docs, str(tmp_path))
    assert not left_of(spark, before)
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - tables] == ["repeats"]
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, passage), (2, "more "), (3, "other words")]
