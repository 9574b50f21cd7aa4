"""Streaming queries over the events, run until what has arrived is read; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.plans import query
from roadloom.plans.panel_queries import rounded
from roadloom.sources.tables import table
from roadloom.streaming import speeds as S


def events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return S.speed_stream(spark, f"{sf_dir}/events.parquet*", schema)


HARM = "count(*) FILTER ({0}) / sum(1 / value) FILTER ({0})"


@query("stream_harmonic_speed", f"SELECT user_id AS roadseg_id, count(*) AS n, round({HARM.format('true')}, 6) AS speed_all, round({HARM.format('hour(ts) IN (7, 8)')}, 6) AS speed_am, round({HARM.format('hour(ts) IN (17, 18)')}, 6) AS speed_pm, round({HARM.format('hour(ts) >= 22 OR hour(ts) <= 5')}, 6) AS speed_ff FROM events WHERE value > 0 GROUP BY 1")
def stream_harmonic_speed(spark, sf_dir):
    """ST01."""
    return rounded(S.run_to_table(S.harmonic_speeds(events(spark, sf_dir), "user_id", "value", "ts"), "harmonic", "complete"))


@query("stream_dedupe", "SELECT DISTINCT user_id FROM events")
def stream_dedupe(spark, sf_dir):
    """ST02: within a watermark wider than the data, so that each key comes once."""
    return S.run_to_table(S.first_seen(events(spark, sf_dir), "user_id", "ts", "365 days").select("user_id"), "dedupe", "append")


@query("stream_hourly", "SELECT date_trunc('hour', ts) AS hour, user_id AS roadseg_id, count(*) AS n, round(count(*) / sum(1 / value), 6) AS speed FROM events WHERE value > 0 GROUP BY ALL")
def stream_hourly(spark, sf_dir):
    """ST03: tumbling hours; complete mode gives the windows that are still open as well."""
    out = S.run_to_table(S.hourly_speeds(events(spark, sf_dir), "user_id", "value", "ts"), "hourly", "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "roadseg_id", "n", F.round("speed", 6).alias("speed"))
