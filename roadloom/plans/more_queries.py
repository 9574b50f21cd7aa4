"""Grid, export, matching-master and figure-data queries that complete the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadloom.functions.columns import ratio
from roadloom.operators import graph as G
from roadloom.operators import relational as R
from roadloom.operators import spatial as S
from roadloom.plans import query
from roadloom.plans.geometry_queries import NEARS, VERT, first_points
from roadloom.plans.graph_queries import PATHS, paths
from roadloom.plans.od_queries import EDGES, LANE, MATCH, OD, grid_edges, lanes, matches, od_matrix
from roadloom.plans.panel_queries import ASYM, asymmetry, rounded
from roadloom.sources.tables import table


@query("match_master", f"WITH {MATCH}, lines AS (SELECT DISTINCT l_partkey % 100 AS cline_id FROM lineitem WHERE l_partkey % 100 < 90) SELECT l_orderkey, l_linenumber, m.cline_id, method, CASE WHEN method = 'unmatched' THEN 0 ELSE 1 END AS matched, lines.cline_id IS NOT NULL AS key_found, (method = 'projection_fallback' AND apl > 120)::INT AS review_flag, 0 AS match_conflict_flag, span FROM m LEFT JOIN lines ON m.cline_id = lines.cline_id")
def match_master(spark, sf_dir):
    """Final method, found keys, review and conflict flags in one pass and one join."""
    m = matches(spark, sf_dir)
    known = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("cline_id")).where("cline_id < 90").distinct().withColumn("_found", F.lit(True))
    review = ((F.col("method") == "projection_fallback") & (F.col("apl") > 120)).cast("int")
    return m.join(known, "cline_id", "left").select("l_orderkey", "l_linenumber", "cline_id", "method", F.when(F.col("method") == "unmatched", 0).otherwise(1).alias("matched"), F.coalesce("_found", F.lit(False)).alias("key_found"), review.alias("review_flag"), F.lit(0).alias("match_conflict_flag"), "span")


@query("override_single_split", "SELECT l_orderkey, min(l_linenumber) AS split_id FROM lineitem GROUP BY 1 HAVING count(*) = 1")
def override_single_split(spark, sf_dir):
    """Edges with exactly one split, which an override by edge may name."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("split_id")).where("n = 1").drop("n")


@query("t_edges", "WITH e AS (SELECT l_suppkey % 10 AS grid_o, l_partkey % 12 AS grid_d, l_quantity * 10 / (1 + l_extendedprice / 1000) AS t FROM lineitem), m AS (SELECT grid_o, grid_d, min(t) AS t FROM e WHERE t > 0 AND grid_o <> grid_d GROUP BY ALL), n AS (SELECT g, row_number() OVER (ORDER BY CAST(g AS VARCHAR)) - 1 AS i FROM (SELECT grid_o AS g FROM m UNION SELECT grid_d FROM m)) SELECT grid_o, grid_d, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(t, 6) AS t_min FROM m JOIN n a ON a.g = grid_o JOIN n b ON b.g = grid_d")
def t_edges(spark, sf_dir):
    """Least time of parallel edges, and the one numbering of nodes."""
    li = table(spark, sf_dir, "lineitem")
    e = li.select((F.col("l_suppkey") % 10).alias("grid_o"), (F.col("l_partkey") % 12).alias("grid_d"), (F.col("l_quantity") * 10 / (1 + F.col("l_extendedprice") / 1000)).alias("t"))
    m = e.where("t > 0 AND grid_o <> grid_d").groupBy("grid_o", "grid_d").agg(F.min("t").alias("t"))
    n = G.numbered_nodes(m.select(F.col("grid_o").alias("g")).union(m.select("grid_d")), "g")
    o, d = n.select(F.col("g").alias("grid_o"), F.col("node_i").alias("i")), n.select(F.col("g").alias("grid_d"), F.col("node_i").alias("j"))
    return m.join(o, "grid_o").join(d, "grid_d").select("grid_o", "grid_d", "i", "j", F.round("t", 6).alias("t_min"))


@query("qsm_od", f"WITH {OD} SELECT home_grid, work_grid, pop, round(pop / sum(pop) OVER (), 9) AS share, 'square' AS grid_type FROM od WHERE pop > 0")
def qsm_od(spark, sf_dir):
    """Flows as shares; the total is one number."""
    o = od_matrix(spark, sf_dir).where("pop > 0")
    return o.select("home_grid", "work_grid", "pop", F.round(F.col("pop") / F.sum("pop").over(Window.partitionBy()), 9).alias("share"), F.lit("square").alias("grid_type"))


@query("home_work_cells", "SELECT c_nationkey // 5 AS home_cell, s_nationkey // 5 AS work_cell, count(*) AS trips FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def home_work_cells(spark, sf_dir):
    """Both ends of trips in cells; a cell is arithmetic on the position."""
    from roadloom.plans.od_queries import trips

    cell = lambda c: F.floor(F.col(c) / 5).cast("int")
    return trips(spark, sf_dir).groupBy(cell("home_grid").alias("home_cell"), cell("work_grid").alias("work_cell")).agg(F.count("*").alias("trips"))


@query("hist_ratio_50", f"WITH {ASYM} SELECT peak, CAST(least(floor(ratio / 0.02), 49) AS INTEGER) AS bin, count(*) AS n FROM asym WHERE ratio IS NOT NULL GROUP BY ALL")
def hist_ratio_50(spark, sf_dir):
    """50 bins between 0 and 1."""
    a = asymmetry(spark, sf_dir).where("ratio IS NOT NULL")
    return a.groupBy("peak", F.least(F.floor(F.col("ratio") / 0.02), F.lit(49)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("lane_symmetry", f"WITH {LANE} SELECT count(*) AS n, count(*) FILTER (greatest(ab, ba) / least(ab, ba) <= 1.5) AS symmetric, round(avg(ab - ba), 6) AS mean_diff FROM opp")
def lane_symmetry(spark, sf_dir):
    two = lanes(spark, sf_dir).groupBy("cline_id").pivot("dir", ["AB", "BA"]).agg(F.first("lane_len"))
    return two.agg(F.count("*").alias("n"), F.count_if(F.greatest("AB", "BA") / F.least("AB", "BA") <= 1.5).alias("symmetric"), F.round(F.avg(F.col("AB") - F.col("BA")), 6).alias("mean_diff"))


@query("lane_by_edge", f"WITH {LANE}, {EDGES} SELECT grid_o, grid_d, round(avg(lane_len), 6) AS lane FROM edges LEFT JOIN lw ON cline_id % 25 = grid_o AND dir = CASE WHEN grid_o < grid_d THEN 'AB' ELSE 'BA' END GROUP BY ALL")
def lane_by_edge(spark, sf_dir):
    """An ordinary left join on the edge's key (survey T2)."""
    lw = lanes(spark, sf_dir).select((F.col("cline_id") % 25).alias("grid_o"), F.col("dir"), "lane_len")
    e = grid_edges(spark, sf_dir).withColumn("dir", F.when(F.col("grid_o") < F.col("grid_d"), "AB").otherwise("BA"))
    return e.join(lw, ["grid_o", "dir"], "left").groupBy("grid_o", "grid_d").agg(F.round(F.avg("lane_len"), 6).alias("lane"))


@query("centroid_distance_time", f"WITH {VERT}{NEARS} SELECT seg_id, cline_id, round(dist, 4) AS dist, round(60 * dist / 1000 / 30, 6) AS edge_tt_min FROM p WHERE dist <= 100")
def centroid_distance_time(spark, sf_dir):
    """Minutes from the distance of two centres and a speed."""
    a, b = first_points(spark, sf_dir)
    near = S.within_distance(a, b, "seg_id", "cline_id", 100.0)
    return near.select("seg_id", "cline_id", F.round("dist", 4).alias("dist"), F.round(60 * F.col("dist") / 1000 / 30, 6).alias("edge_tt_min"))


@query("within_stats", "WITH v AS (SELECT vec_id, floor(embedding[2 * k + 1] * 1000.0::DOUBLE / 800 + 0.5) AS i, floor(embedding[2 * k + 2] * 1000.0::DOUBLE / 800 + 0.5) AS j FROM embeddings, LATERAL unnest(range(0, 32)) AS t(k)), c AS (SELECT vec_id, count(DISTINCT (i, j)) AS cells FROM v GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (cells = 1) AS within, round(count(*) FILTER (cells = 1) / count(*), 6) AS share FROM c")
def within_stats(spark, sf_dir):
    """J12, J13, TS5: lines all of whose vertices lie in one cell of 800."""
    from roadloom.plans.geometry_queries import lines

    cell = lambda p: F.struct(F.floor(p.getField("x") / 800 + 0.5), F.floor(p.getField("y") / 800 + 0.5))
    c = lines(spark, sf_dir).select(F.size(F.array_distinct(F.transform("geom", cell))).alias("cells"))
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("cells") == 1).alias("within"), F.round(F.count_if(F.col("cells") == 1) / F.count("*"), 6).alias("share"))


@query("augmented_costs", f"WITH RECURSIVE {PATHS} SELECT o + 1000 AS grid_o, d + 1000 AS grid_d, round(t + 1.0, 6) AS t_min FROM best WHERE o <> d")
def augmented_costs(spark, sf_dir):
    """Grid to grid through connectors of half a minute that lead both ways between a cell (1000 + node) and its node."""
    e = grid_edges(spark, sf_dir)
    node = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    up = node.select((F.col("k") + 1000).alias("grid_o"), F.col("k").alias("grid_d"), F.lit(0.5).alias("t_min"))
    down = node.select("k", (F.col("k") + 1000).alias("c"), F.lit(0.5).alias("t_min")).toDF("grid_o", "grid_d", "t_min")
    p = G.shortest_paths(e.unionByName(up).unionByName(down), "grid_o", "grid_d", "t_min")
    return rounded(p.where("grid_o >= 1000 AND grid_d >= 1000"))


@query("old_cost_ratio", f"WITH RECURSIVE {PATHS} SELECT b.o AS grid_o, b.d AS grid_d, round(e.t_min / b.t, 6) AS ratio FROM best b JOIN edges e ON e.grid_o = b.o AND e.grid_d = b.d WHERE b.o <> b.d")
def old_cost_ratio(spark, sf_dir):
    """Direct edge against best path."""
    e = grid_edges(spark, sf_dir).withColumnRenamed("t_min", "direct")
    return e.join(paths(spark, sf_dir), ["grid_o", "grid_d"]).select("grid_o", "grid_d", F.round(ratio(F.col("direct"), F.col("t_min")), 6).alias("ratio"))


@query("json_points", "SELECT user_id, count(*) AS n, min(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS first_k, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS last_k FROM events GROUP BY 1")
def json_points(spark, sf_dir):
    """Values from JSON texts."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min(k).alias("first_k"), F.max(k).alias("last_k"))


@query("clipped_scale", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem) SELECT l_returnflag, round(avg((greatest(lo, least(hi, l_extendedprice)) - lo) / (hi - lo)), 6) AS scaled FROM lineitem, q GROUP BY 1")
def clipped_scale(spark, sf_dir):
    """Values clipped at quantiles and scaled between them; the bounds are one row."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    q = li.agg(F.percentile("l_extendedprice", 0.02).alias("lo"), F.percentile("l_extendedprice", 0.98).alias("hi")).first()
    v = (F.greatest(F.lit(q.lo), F.least(F.lit(q.hi), F.col("l_extendedprice"))) - q.lo) / (q.hi - q.lo)
    return li.groupBy("l_returnflag").agg(F.round(F.avg(v), 6).alias("scaled"))


@query("value_counts", "SELECT p_brand, p_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY ALL")
def value_counts(spark, sf_dir):
    """A24."""
    return rounded(R.shares(table(spark, sf_dir, "part"), ["p_brand", "p_type"]))


@query("distinct_counts", "SELECT count(DISTINCT l_orderkey) AS edges, count(DISTINCT l_partkey % 100) AS clines, (SELECT count(*) FROM (SELECT DISTINCT l_partkey % 100, l_linestatus FROM lineitem)) AS directed FROM lineitem")
def distinct_counts(spark, sf_dir):
    """A16, A17."""
    li = table(spark, sf_dir, "lineitem")
    c = F.col("l_partkey") % 100
    return li.agg(F.count_distinct("l_orderkey").alias("edges"), F.count_distinct(c).alias("clines"), F.count_distinct(c, F.col("l_linestatus")).alias("directed"))


@query("adjacency", f"WITH {EDGES} SELECT grid_o AS node, count(DISTINCT grid_d) AS n, string_agg(DISTINCT grid_d::VARCHAR, ',' ORDER BY grid_d::VARCHAR) AS neighbours FROM edges GROUP BY 1")
def adjacency(spark, sf_dir):
    """A48."""
    s = F.array_sort(F.transform(F.collect_set("grid_d"), lambda x: x.cast("string")))
    return grid_edges(spark, sf_dir).groupBy(F.col("grid_o").alias("node")).agg(F.count_distinct("grid_d").alias("n"), F.array_join(s, ",").alias("neighbours"))


@query("od_subset_margins", f"WITH {OD}, s AS (SELECT * FROM od WHERE (home_grid + work_grid) % 3 > 0) SELECT home_grid AS grid_id, round(sum(pop) / (SELECT sum(pop) FROM s), 9) AS residents FROM s GROUP BY 1")
def od_subset_margins(spark, sf_dir):
    """Margins of the flows that have a path, as shares."""
    s = od_matrix(spark, sf_dir).where("(home_grid + work_grid) % 3 > 0").groupBy(F.col("home_grid").alias("grid_id")).agg(F.sum("pop").alias("p"))
    return s.select("grid_id", F.round(F.col("p") / F.sum("p").over(Window.partitionBy()), 9).alias("residents"))


@query("demeaned", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey)) * count(*) OVER (PARTITION BY l_suppkey), 0) AS x FROM lineitem")
def demeaned(spark, sf_dir):
    """Distance from the group's mean, times the group's size so that it is whole."""
    w = Window.partitionBy("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round((F.col("l_quantity") - F.avg("l_quantity").over(w)) * F.count("*").over(w), 0).alias("x"))


@query("composite_left_join", "SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def composite_left_join(spark, sf_dir):
    """Left join with a condition on the right side, which Catalyst pushes into its scan."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left").drop("c_custkey")
