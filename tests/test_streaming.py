"""Streaming queries on rows that the smallest tables do not have."""

import datetime as dt

import duckdb

from roadloom.plans import ORACLES, QUERIES, catalog
from roadloom.streaming.speeds import first_seen, hourly_speeds, run_to_table

catalog.load()


def test_hours_and_roads_without_a_positive_speed_have_no_row(spark, tmp_path):
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01 0{h}:10:00', {road}, {v})" for i, (h, road, v) in enumerate([(1, 1, 20.0), (1, 1, 0.0), (2, 1, 0.0), (1, 2, 0.0), (2, 3, -5.0), (2, 3, 40.0), (3, 4, "NULL")]))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, value::DOUBLE AS value FROM (VALUES {rows}) AS t(event_id, ts, user_id, value)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("stream_hourly", "stream_harmonic_speed"):
        want = con.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        got = QUERIES[name](spark, str(tmp_path)).select(names).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_results_are_tables_of_the_shared_folder_whole_after_several_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(10 * i + j, dt.datetime(2024, 1, 1, i), j % 2, 10.0 + i) for j in range(4)], "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    raw = spark.readStream.schema("event_id long, ts timestamp, user_id long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    hourly = run_to_table(hourly_speeds(raw, "user_id", "value", "ts"), "hourly", "complete")
    assert sorted((r.roadseg_id, r.n, r.speed) for r in hourly.collect()) == sorted((u, 2, 10.0 + i) for u in (0, 1) for i in range(3))
    assert "MemoryPlan" not in hourly._jdf.queryExecution().optimizedPlan().toString() and hourly.inputFiles()
    first = run_to_table(first_seen(raw, "user_id", "ts", "365 days").select("user_id"), "dedupe", "append")
    assert sorted(r.user_id for r in first.collect()) == [0, 1] and first.inputFiles()
    none = raw.where("value < 0")
    assert run_to_table(first_seen(none, "user_id", "ts", "365 days"), "none", "append").count() == run_to_table(hourly_speeds(none, "user_id", "value", "ts"), "none", "complete").count() == 0
