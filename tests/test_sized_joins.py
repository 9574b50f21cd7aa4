"""Joins whose rows would grow with the square of a group: results by DuckDB's SQL, and no row for each pair in the plan."""

import duckdb

from roadloom.plans import ORACLES, QUERIES, catalog

catalog.load()


def answers(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"CREATE TABLE {t} AS {sql}")
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, df.select(names).collect()))) == sorted(map(repr, want.fetchall()))
    return df._jdf.queryExecution().optimizedPlan().toString()


EVENTS = "SELECT i::BIGINT AS event_id, (i * 37 % 500)::DOUBLE AS value FROM range(3000) t(i)"


def test_observations_of_a_road_are_summed_before_its_segments_are_joined(spark, tmp_path):
    part = "SELECT (i % 900)::BIGINT AS p_partkey FROM range(1000) t(i)"  # a hundred segments are told twice
    plan = answers(spark, tmp_path, "obs_by_segment", events=EVENTS, part=part)
    join = next(i for i, line in enumerate(plan.splitlines()) if "Join" in line)
    assert not any("Aggregate" in line for line in plan.splitlines()[:join])


def test_sources_of_one_extent_meet_pieces_without_a_row_for_each_pair(spark, tmp_path):
    part = "SELECT i::BIGINT AS p_partkey, (900 + i // 200 % 3)::DOUBLE AS p_retailprice, (1 + i % 7)::INTEGER AS p_size FROM range(4000) t(i)"
    plan = answers(spark, tmp_path, "lineage", events=EVENTS, part=part)
    assert "FlatMapCoGroupsInArrow" in plan and not any("_tile" in line for line in plan.splitlines() if "Join" in line)
