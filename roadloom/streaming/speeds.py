"""Structured Streaming forms of the chunked aggregates (ST01-ST03)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.columns import is_am, is_freeflow, is_pm
from roadloom.operators.panel import harmonic
from roadloom.sources.store import shared_dir


def speed_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the files that arrive under `path`; times are cast to timestamps, which watermarks need."""
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def harmonic_speeds(events: DataFrame, road: str, speed: str, ts: str) -> DataFrame:
    """ST01: n and harmonic speed of each road with a positive speed, for all times, peaks and free flow; state is a few sums a road."""
    v, h = F.col(speed), F.hour(ts)
    of = lambda ok: harmonic(F.when(ok, v))
    return events.where(v > 0).groupBy(F.col(road).alias("roadseg_id")).agg(F.count("*").alias("n"), of(F.lit(True)).alias("speed_all"), of(is_am(h)).alias("speed_am"), of(is_pm(h)).alias("speed_pm"), of(is_freeflow(h)).alias("speed_ff"))


def first_seen(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """ST02, U06: the first row of each key; keys are forgotten once the watermark has passed them by `delay`."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def hourly_speeds(events: DataFrame, road: str, speed: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """ST03: harmonic speed by road and hour with a positive speed; late rows count until the watermark passes their hour."""
    # filtered after the watermark, so rows without a speed still move it on
    return events.withWatermark(ts, delay).where(F.col(speed) > 0).groupBy(F.window(ts, "1 hour"), F.col(road).alias("roadseg_id")).agg(F.count("*").alias("n"), harmonic(F.col(speed)).alias("speed"))


def run_to_table(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run what has arrived so far to its end and return the result table, which executors write to the shared folder as they do progress.

    In complete mode each batch writes the whole result anew and the last one
    counts; in append mode it is the rows of all batches. A batch that is run
    again replaces what it has written.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{name}_{uuid.uuid4().hex}"
    done = []

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        if mode == "complete":
            done.clear()
        if path not in done:
            done.append(path)

    run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema(stream.schema)
    return found.parquet(*done) if done else spark.createDataFrame([], stream.schema)
