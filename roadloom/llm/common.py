"""What several of the operators share: the shared folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch on its way to a Python worker; a single row may take more.
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[list[tuple[str, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='roadloom-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    for made in _made:
        made.append((what, path))
    return path


@contextmanager
def dropped_after(spark: SparkSession, but: str) -> Iterator[None]:
    """Folders made within it are deleted when it ends well, but those made for `but`, which must hold all that is read later."""
    made: list[tuple[str, str]] = []
    _made.append(made)
    try:
        yield
    finally:
        _made.pop()
    for what, path in made:
        if what != but:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within it, `key` has `value`; the session's own setting is back after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: int = BATCH) -> AbstractContextManager[None]:
    """Within it, jobs send Python workers Arrow batches of `size` bytes at most, so rows of long texts or sets do not add up."""
    return _setting(spark, _BATCH, str(size))


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, the shuffle files of a query are deleted on all executors when it ends, not when the driver happens to collect its garbage."""
    return _setting(spark, _CLEANUP, "true")


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table written to the shared folder and read again: it cuts lineage and survives lost executors, and its shuffles leave the disk."""
    path = new_folder(df.sparkSession, what)
    with small_batches(df.sparkSession), freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def balanced_labels(spark: SparkSession, n: int) -> list[int]:
    """n distinct integers that hash partitioning on an int column deals out evenly over the session's shuffle partitions."""
    parts = partitions(spark)
    rounds = -(-n // parts)
    rows = spark.range(0, 40 * (rounds + 10) * parts, 1, 1).selectExpr("CAST(id AS INT) AS id", f"pmod(hash(CAST(id AS INT)), {parts}) AS p")
    of: dict[int, list[int]] = {}
    for r in rows.groupBy("p").agg(F.slice(F.array_sort(F.collect_list("id")), 1, rounds).alias("ids")).collect():
        of[r["p"]] = r["ids"]
    return [of[i % parts][i // parts] for i in range(n)]
