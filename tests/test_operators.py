"""Small fixtures whose results were worked out by hand, and properties that must hold."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import columns as C
from roadloom.functions import geometry as G
from roadloom.operators import graph, matching, model, panel, pipeline, raster, relational, spatial
from roadloom.sources import store, text


def line(*points):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_mercator(spark):
    r = one(spark, C.mercator_x(F.lit(116.397389)).alias("x"), C.mercator_y(F.lit(39.908722)).alias("y"))
    assert (round(r.x, 4), round(r.y, 4)) == (12957298.0731, 4852686.8615)


def test_line_measures(spark):
    g = line((0, 0), (3, 4), (3, 10))
    m = G.measured(g)
    r = one(spark, G.length(g).alias("n"), G.bearing(g).alias("b"), G.midpoint(g).alias("m"), G.projected(m, G.point(F.lit(6.0), F.lit(7.0))).alias("p"))
    assert r.n == 11 and round(r.b, 4) == 16.6992 and (r.m.x, r.m.y) == (3, 4.5) and (r.p.d, r.p.s) == (3, 8)


def test_sampled_distance(spark):
    a = G.sampled_distance(line((0, 0), (70, 0)), G.measured(line((-100, 10), (100, 10))), 30)
    b = G.sampled_distance(line((0, 0), (0, 60)), G.measured(line((0, 0), (100, 0))), 30)
    assert one(spark, a.alias("a"), b.alias("b")) == (10.0, 30.0)


def test_polygon_clip_and_cuts(spark):
    ring = line((0, 0), (4, 0), (4, 2), (0, 2))
    inside = [G.contains(ring, G.point(F.lit(x), F.lit(1.0))).alias(f"p{i}") for i, x in enumerate((1.0, 5.0))]
    cell = [F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)]
    r = one(spark, G.signed_area(ring).alias("a"), G.centroid(ring).alias("c"), *inside, G.clipped_length(line((-5, 5), (15, 5)), *cell).alias("n"), G.chord_middles(G.measured(line((0, 0), (100, 0))), G.point(F.lit(50.0), F.lit(0.0)), 10.0).alias("k"))
    assert r.a == 8 and (r.c.x, r.c.y) == (2, 1) and r.p0 and not r.p1 and r.n == 10 and r.k == [50]


def test_angles_and_wkt(spark):
    r = one(spark, C.wkt_points(F.lit("LINESTRING Z (1 2 0, 3.5 -4 0)")).alias("w"), C.wkt_points(F.lit("POINT (1 2)")).alias("n"), C.downsampled(line(*[(i, 0) for i in range(9)]), 3).alias("d"))
    assert [(p.x, p.y) for p in r.w] == [(1, 2), (3.5, -4)] and r.n is None and [p.x for p in r.d] == [0, 4, 8]


def test_speeds(spark):
    rows = [(1, "AB", "weekday", 7, 100.0, 50.0, 1, 1), (1, "AB", "weekday", 7, 300.0, 100.0, 1, 1), (1, "AB", "weekday", 7, 9.0, 0.0, 1, 1), (1, "AB", "weekday", 7, 9.0, 9.0, 0, 1)]
    obs = spark.createDataFrame(rows, "cline_id int, dir string, weekday_label string, hour_of_day int, seg_len_m double, speed double, matched int, dt int")
    assert panel.speed_panel(obs).first().cl_speed_kmh == 80
    assert obs.where("matched = 1 AND speed > 0").agg(panel.weighted_mean(F.col("speed"), F.col("seg_len_m"))).first()[0] == 87.5
    assert round(obs.where("matched = 1").agg(panel.harmonic(F.col("speed"))).first()[0], 4) == 66.6667


def test_asymmetry_rules(spark):
    rows = [(1, "AM", 20.0, 50.0), (2, "AM", 30.0, 30.0), (3, "AM", None, 40.0), (4, "AM", 10.0, 50.0)]
    got = {r.cline_id: r for r in panel.with_asymmetry(spark.createDataFrame(rows, "cline_id int, peak string, speed_ab double, speed_ba double")).collect()}
    assert (got[1].ratio, round(got[1].ratio2, 6), got[1].unsym1, got[1].unsym2, got[1].unsym3, got[1].faster_dir) == (0.4, 0.428571, True, False, False, "BA")
    assert (got[2].ratio, got[2].unsym1, got[2].faster_dir) == (1, False, "BA")
    assert got[3].unsym1 is None and got[3].miss_one_dir and not got[3].miss_both
    assert (got[4].ratio, got[4].unsym1, got[4].unsym2, got[4].unsym3) == (0.2, True, True, True)


def test_islands_and_runs(spark):
    cuts = spark.createDataFrame([(1, s, 300.0) for s in (0.5, 10.0, 35.0, 60.0, 200.0, 299.5)], "k int, s double, len double")
    assert sorted(r.s for r in relational.merged_cuts(cuts, "k", "s", "len", 30.0).collect()) == [35, 200]
    seq = spark.createDataFrame([(1, 0, "A", 100), (1, 1, "A", 50), (1, 2, "B", 30), (1, 3, "A", 20)], "k int, i int, cell string, len int")
    runs = relational.run_lengths(seq, ["k"], ["i"], "cell", "len")
    assert [(r.cell, r.len) for r in runs.orderBy("run").collect()] == [("A", 150), ("B", 30), ("A", 20)]
    assert sorted((r.grid_o, r.grid_d, r.len) for r in relational.consecutive(runs, ["k"], ["run"], "cell", "len").collect()) == [("A", "B", 150), ("B", "A", 30)]


def test_ranks_and_histogram(spark):
    v = spark.createDataFrame([(10.0,), (10.0,), (30.0,)], "v double")
    assert sorted(r[0] for r in v.select(relational.average_rank("v")).collect()) == [0.5, 0.5, 1.0]
    h = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,)], "v double")
    assert {r.bin: r.n for r in relational.histogram(h, "v", 2).collect()} == {0: 3, 1: 1}


def test_graph_fixture(spark):
    e = spark.createDataFrame([(1, 2, 2.0), (2, 3, 2.0), (1, 3, 10.0), (4, 5, 1.0)], "grid_o long, grid_d long, t_min double")
    p = {(r.grid_o, r.grid_d): r.t_min for r in graph.shortest_paths(e, "grid_o", "grid_d", "t_min").collect()}
    assert p[1, 3] == 4 and (3, 1) not in p
    c = {r.node: r.component for r in graph.components(e, "grid_o", "grid_d", spark.createDataFrame([(9,)], "node long")).collect()}
    assert c == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9}
    soft = spark.createDataFrame([(1, 2, 2.0), (2, 3, 2.0), (1, 3, 4.0)], "grid_o long, grid_d long, t_min double")
    z = graph.soft_values(soft, spark.createDataFrame([(3,)], "dest long"), 1.0, 5)
    assert {r.i: r.z for r in z.collect()} == {1: 0.5, 2: 0.5, 3: 1.0}
    f = graph.soft_flows(soft, z, spark.createDataFrame([(1, 3, 10.0)], "home long, work long, pop double"), 1.0, 5)
    assert {(r.i, r.j): r.flow for r in f.collect()} == {(1, 2): 5, (2, 3): 5, (1, 3): 5}


def test_two_way_effects_and_lanes(spark):
    rows = [(o, d, 1.0 + (3 * o + 5 * d) % 7) for o in range(4) for d in range(4)]
    od = spark.createDataFrame(rows, "o int, d int, tau double").withColumn("pop", F.exp(0.3 * F.col("o") - 0.2 * F.col("d") - 2 * F.log("tau")))
    r = model.theta_two_way(od, 40).first()
    assert (round(r.beta, 5), round(r.theta, 5)) == (-2, 2)
    e = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 4.0), (2.0, 8.0)], "lane double, density double")
    e = e.select("lane", (F.col("density") * F.col("lane")).alias("flow"), F.lit(1.0).alias("t_ff"), (F.pow("density", F.lit(0.3)) * F.col("lane")).alias("t_obs"))
    assert round(model.lambda_by_lane(e).first()[0], 9) == 0.3


def test_lane_reallocation(spark):
    e = spark.createDataFrame([(1, 2, 2.0), (2, 1, 1.0), (3, 1, 4.0)], "grid_o int, grid_d int, lane double")
    got = {(r.grid_o, r.grid_d): r.lane for r in model.reallocated(e, e.where("grid_o = 1")).collect()}
    assert got == {(1, 2): 3, (2, 1): 0.25, (3, 1): 4}


def test_spatial_joins_equal_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(150)]
    a = spark.createDataFrame(pts, "a long, x double, y double")
    got = {(r.a, r.b) for r in spatial.within_distance(a, a.withColumnRenamed("a", "b"), "a", "b", 40.0).collect()}
    assert got == {(i, j) for i, x, y in pts for j, u, v in pts if np.hypot(x - u, y - v) <= 40}
    seeds = [(r.a, r.x, r.y) for r in spatial.poisson_seeds(a, "a", 40.0).collect()]
    assert all(np.hypot(x - u, y - v) >= 40 for i, x, y in seeds for j, u, v in seeds if i < j)
    assert all(any(np.hypot(x - u, y - v) < 40 for _, u, v in seeds) for _, x, y in pts)


def test_thinning_and_chains(spark):
    image = np.zeros((30, 12), bool)
    image[2:28, 3:8] = True
    kept = raster.thin(image, 20)
    assert 15 <= kept.sum() <= 40 and kept.any(axis=1).sum() >= 18
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("e", "f")], "x string, y string")
    got = {}
    for r in raster.chains(links, "x", "y").collect():
        got.setdefault(r.chain, set()).add((r.a, r.b))
    assert sorted(map(sorted, got.values())) == [[("a", "b"), ("b", "c")], [("c", "d")], [("c", "e"), ("e", "f")]]


def test_noding(spark):
    rows = spark.range(2).select(F.col("id").alias("k"), F.when(F.col("id") == 0, line((0, 0), (10, 0))).otherwise(line((4, -5), (4, 5))).alias("geom"))
    parts = matching.split_at(rows, matching.crossings(rows, "k", "geom", 5.0), "k", "geom")
    assert sorted((r.k, r.part, r.s_from, r.s_to) for r in parts.collect()) == [(0, 0, 0, 4), (0, 1, 4, 10), (1, 0, 0, 5), (1, 1, 5, 10)]


def test_projection_of_a_parallel_line(spark):
    m = matching.projection_metrics(G.measured(line((0, 0), (90, 0))), G.measured(line((-10, 20), (200, 20))), 30.0)
    r = one(spark, m.alias("m")).m
    assert (r.length, r.area, r.apl, r.d_mean, r.s_from, r.s_to) == (90, 1800, 20, 20, 10, 100)


def test_one_to_one_and_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (1, "z")], "k int, w string")
    assert relational.checked_one_to_one(a, b.limit(1), "k").count() == 1
    with pytest.raises(Exception, match="not unique"):
        relational.checked_one_to_one(a, b, "k").collect()
    with pytest.raises(ValueError):
        store.required_columns(a, "k", "q")


def test_stages_run_in_order_and_resume(spark, tmp_path):
    stages = [pipeline.Stage("one", lambda s, t, c: {"a": s.range(3)}), pipeline.Stage("two", lambda s, t, c: {"b": t["a"].where("id > 0")}, needs=("a",))]
    p, root = pipeline.Pipeline(stages), f"file://{tmp_path}"
    assert p.run(spark, root, pipeline.Config())["b"].count() == 2
    assert p.run(spark, root, pipeline.Config(), first="two")["b"].count() == 2
    with pytest.raises(ValueError):
        p.between("two", "one")
    with pytest.raises(FileNotFoundError):
        p.run(spark, root, pipeline.Config(version_id="none"), first="two")


def test_encodings(spark, tmp_path):
    for name in ("utf-8", "gb18030"):
        path = tmp_path / f"{name}.csv"
        path.write_bytes("road,方向\n1,东\n".encode(name))
        found = text.encoding_of(spark, f"file://{path}")
        assert text.csv_table(spark, f"file://{path}", "road int, d string", found).first().d == "东"


def test_thinning_goes_on_until_no_pixel_changes(spark):
    image = np.zeros((300, 150), bool)
    image[5:290, 5:140] = True
    image[100:120, 60:80] = False
    px = spark.createDataFrame([(int(i), int(j)) for i, j in np.argwhere(image)], "px long, py long")
    got = {(r.px, r.py) for r in raster.skeleton_pixels(px, passes=8, tile=64).collect()}
    assert got == {(int(i), int(j)) for i, j in np.argwhere(raster.thin(image, 1000))}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")
def test_every_line_takes_part_in_matching(spark):
    from roadloom.plans import QUERIES, catalog

    catalog.load()
    sf = "/root/testdata/sf0.001"
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    rows = QUERIES["projection_metrics"](spark, sf).select("seg_id", "cline_id").collect()
    assert {r.seg_id for r in rows} | {r.cline_id for r in rows} == ids
