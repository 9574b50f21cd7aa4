"""Lines against lines: all pairs, as the SQL has them, and lines of any number of vertices."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadloom.functions import geometry as G
from roadloom.operators import line_pairs, matching
from roadloom.plans import ORACLES, QUERIES, catalog

catalog.load()


def held_against_sql(spark, folder, name):
    """Twenty lines in four places, thousands apart."""
    rng = random.Random(2)
    at = [(0.0, 0.0), (9.0, 0.0), (0.0, 9.0), (9.0, 9.0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, label INTEGER, embedding FLOAT[])")
    for i in range(20):
        x, y = at[i // 10 * 2 + i % 2]
        con.execute("INSERT INTO embeddings VALUES (?, 0, ?)", [i, [v for _ in range(32) for v in (x + rng.gauss(0, 0.12), y + rng.gauss(0, 0.12))]])
    con.execute(f"COPY embeddings TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(folder)).select(names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_sampled_distance_has_pairs_that_are_far_apart(spark, tmp_path):
    held_against_sql(spark, tmp_path, "sampled_distance")


def test_baseline_match_counts_corridors_that_are_far_apart(spark, tmp_path):
    held_against_sql(spark, tmp_path, "baseline_match")


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(5)
    walk = lambda n: [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(n)]
    rows = [(i, walk(rng.randrange(2, 9))) for i in range(150)] + [(200, [(1.0, 1.0), (1.0, 1.0), (50.0, 1.0)]), (201, [(0.0, 0.0), (2000.0, 0.0)])]
    return spark.createDataFrame(rows, "id long, geom array<struct<x:double,y:double>>")


def test_blocks_of_uneven_lines_measure_as_the_expressions_do(spark, lines):
    a, b = lines.where("id % 2 = 0"), lines.where("id % 2 = 1 AND id < 20 OR id > 199")
    got = {(r.a_id, r.b_id): r for r in line_pairs.sampled_distances(a, b, 70.0).collect()}
    both = a.selectExpr("id AS a", "geom AS g").crossJoin(b.selectExpr("id AS b", "geom AS h"))
    want = both.select("a", "b", G.sampled_distance(F.col("g"), G.measured(F.col("h")), 70.0).alias("d")).collect()
    assert len(got) == len(want) == a.count() * b.count()
    assert all(abs(got[r.a, r.b].d - r.d) < 1e-6 for r in want)


def test_projection_metrics_has_pairs_that_are_far_apart(spark, tmp_path):
    held_against_sql(spark, tmp_path, "projection_metrics")


def test_projections_of_uneven_lines_are_those_of_the_expression(spark, lines):
    a, b = lines.where("id % 2 = 0"), lines.where("id % 2 = 1 AND id < 20 OR id > 199")
    got = {(r.a_id, r.b_id): r for r in line_pairs.projections(a, b, 70.0).collect()}
    both = a.selectExpr("id AS a", "geom AS g").crossJoin(b.selectExpr("id AS b", "geom AS h"))
    want = both.select("a", "b", matching.projection_metrics(G.measured(F.col("g")), G.measured(F.col("h")), 70.0).alias("m")).collect()
    assert len(got) == len(want)
    for r in want:
        x = got[r.a, r.b]
        assert all(abs(x[c] - r.m[c]) < 1e-6 for c in ("length", "area", "apl", "d_mean", "d_max", "s_from", "s_to"))
        close = 120 if r.m.length > 1000 else 60
        assert abs(x.share - sum(d <= close for d in r.m.dists) / len(r.m.dists)) < 1e-9


def test_projection_match_counts_corridors_that_are_far_apart(spark, tmp_path):
    held_against_sql(spark, tmp_path, "projection_match")


def test_least_scores_come_as_a_row_for_each_group_of_lines_and_are_those_of_all_pairs(spark, lines):
    a, b = lines.where("id % 2 = 0"), lines.where("id % 2 = 1")
    every = line_pairs.sampled_distances(a, b, 70.0).collect()
    got = line_pairs.least_scores(a, b, 70.0).collect()
    assert len(every) == a.count() * b.count() == sum(r.n for r in got) and len(got) < len(every) / 4
    assert {k: min((r.score, r.b_id) for r in got if r.a_id == k) for k in {r.a_id for r in got}} == {k: min((r.d + 0.1 * r.ang, r.b_id) for r in every if r.a_id == k) for k in {r.a_id for r in every}}


def test_cells_leave_few_segments_and_not_the_nearest_of_lines_in_two_far_places():
    rng = np.random.default_rng(3)
    n = 400
    place = np.where(np.arange(n) % 2, 5e5, 0.0)[:, None]
    held = {c: pa.array(list(rng.normal(place, 120.0, (n, 32)))) for c in "xy"}
    x = line_pairs.Lines(pa.table({"id": np.arange(n)} | held))
    p = line_pairs.Samples(x, 20.0)
    for j in range(6):
        near = line_pairs.Near(p, x, j)
        d, k, u = line_pairs.feet(p, near, x, j)
        ax, ay, dx, dy = x.ax[j], x.ay[j], x.dx[j], x.dy[j]
        t = np.clip(((p.x[:, None] - ax) * dx + (p.y[:, None] - ay) * dy) / x.square[j], 0, 1)
        all_d = np.hypot(p.x[:, None] - (ax + t * dx), p.y[:, None] - (ay + t * dy))
        assert np.abs(d - all_d.min(1)).max() < 1e-6
        assert near.count[p.cell].mean() < 10


def test_best_projections_come_as_a_row_for_each_group_of_lines_and_are_those_of_all_pairs(spark, lines):
    a, b = lines.where("id % 2 = 0"), lines.where("id % 2 = 1")
    every = line_pairs.projections(a, b, 70.0).collect()
    got = line_pairs.best_projections(a, b, 70.0).collect()
    assert len(every) == a.count() * b.count() == sum(r.n for r in got) and len(got) < len(every) / 4
    best = {}
    for r in every:
        long = r.length > 1000
        if r.s_to > r.s_from and r.d_mean <= 180 and r.apl <= (400 if long else 180) and r.share >= (0.15 if long else 0.3):
            best[r.a_id] = max(best.get(r.a_id, (-9, 0)), (r.share - 0.15 * min(r.apl, 120.0) / 120, -r.b_id))
    found = {k: max((r.score, -r.b_id) for r in got if r.a_id == k and r.b_id is not None) for k in {r.a_id for r in got if r.b_id is not None}}
    assert found.keys() == best.keys() and len(best) > 20
    assert all(found[k][1] == best[k][1] and abs(found[k][0] - best[k][0]) < 1e-9 for k in best)
