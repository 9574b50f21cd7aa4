"""Written tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='roadloom-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """`df`, written and read again."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached_table(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at `path`, made and written first if it is not there; readers see whole tables only."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def required(spark: SparkSession, *paths: str) -> None:
    """Raise FileNotFoundError for the first path that no store has."""
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            raise FileNotFoundError(p)


def required_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Raise ValueError where columns are missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def config_snapshot(spark: SparkSession, path: str, config: dict) -> None:
    """The parameters of a stage as one JSON row."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
