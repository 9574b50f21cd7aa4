"""Pieces, links, topology, tessellations, flags and reruns on the proxies."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import geometry as G
from roadloom.functions.columns import direction_degrees
from roadloom.operators import graph as Gr
from roadloom.operators import network as N
from roadloom.operators import relational as R
from roadloom.operators import spatial as S
from roadloom.operators.matching import needs_split
from roadloom.operators.pipeline import by_grid_type
from roadloom.plans import query
from roadloom.plans.geometry_queries import NEARS, SEG, VERT, first_points, lines
from roadloom.plans.graph_queries import REACH, components
from roadloom.plans.od_queries import EDGES, MATCH, grid_edges, matches
from roadloom.plans.panel_queries import rounded
from roadloom.sources.store import stored
from roadloom.sources.tables import table


@query("obs_by_segment", "SELECT p_partkey AS split_id, count(*) AS n_obs, round(sum(value), 2) AS total, round(avg(value), 4) AS mean FROM events JOIN part ON p_partkey % 50 = event_id % 50 WHERE value > 100 GROUP BY 1")
def obs_by_segment(spark, sf_dir):
    """Each observation with all segments of its road; observations without speed fall out first, and those of a road are summed before its segments are joined."""
    obs = table(spark, sf_dir, "events").where("value > 100").select((F.col("event_id") % 50).alias("roadseg_id"), "value")
    seg = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("split_id"), (F.col("p_partkey") % 50).alias("roadseg_id"))
    road = obs.groupBy("roadseg_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    # a segment that is told twice has the observations twice
    out = seg.groupBy("split_id", "roadseg_id").agg(F.count("*").alias("k")).join(road, "roadseg_id")
    return out.select("split_id", (F.col("k") * F.col("n")).alias("n_obs"), F.round(F.col("k") * F.col("v"), 2).alias("total"), F.round(F.col("v") / F.col("n"), 4).alias("mean"))


PIECES = SEG + """, c AS (SELECT vec_id, k, "from" AS f, len, ax, ay, bx - ax AS dx, byy - ay AS dy, unnest(range(CAST(floor(least(ax, bx) / 150) AS BIGINT), CAST(floor(greatest(ax, bx) / 150) AS BIGINT) + 1)) AS i, ay AS y0, byy AS y1 FROM s),
cc AS (SELECT *, unnest(range(CAST(floor(least(y0, y1) / 150) AS BIGINT), CAST(floor(greatest(y0, y1) / 150) AS BIGINT) + 1)) AS j FROM c),
t AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN (i * 150 - ax) / dx WHEN dx < 0 THEN ((i + 1) * 150 - ax) / dx ELSE 0 END, CASE WHEN dy > 0 THEN (j * 150 - ay) / dy WHEN dy < 0 THEN ((j + 1) * 150 - ay) / dy ELSE 0 END) AS t0,
 least(1, CASE WHEN dx > 0 THEN ((i + 1) * 150 - ax) / dx WHEN dx < 0 THEN (i * 150 - ax) / dx ELSE 1 END, CASE WHEN dy > 0 THEN ((j + 1) * 150 - ay) / dy WHEN dy < 0 THEN (j * 150 - ay) / dy ELSE 1 END) AS t1 FROM cc),
pieces AS (SELECT vec_id, i, j, f + t0 * len AS start, (t1 - t0) * len AS len FROM t WHERE t1 > t0)"""


def pieces(spark, sf_dir):
    return N.cell_pieces(lines(spark, sf_dir), "vec_id", "geom", 150.0)


@query("grid_pieces", f"WITH {PIECES} SELECT vec_id, 'sq_' || j || '_' || i AS grid_id, count(*) AS n, round(sum(len), 3) AS len_m FROM pieces GROUP BY ALL")
def grid_pieces(spark, sf_dir):
    """Length of every line in every cell that it passes."""
    return pieces(spark, sf_dir).groupBy("vec_id", F.concat(F.lit("sq_"), "j", F.lit("_"), "i").alias("grid_id")).agg(F.count("*").alias("n"), F.round(F.sum("len"), 3).alias("len_m"))


@query("piece_links", f"WITH {PIECES}, q AS (SELECT vec_id, start, len, 'sq_' || j || '_' || i AS cell FROM pieces), n AS (SELECT *, CASE WHEN cell = lag(cell) OVER w THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY vec_id ORDER BY start)), r AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM n), g AS (SELECT vec_id, run, cell, sum(len) AS len FROM r GROUP BY ALL), l AS (SELECT cell AS grid_o, lead(cell) OVER (PARTITION BY vec_id ORDER BY run) AS grid_d, len FROM g) SELECT grid_o, grid_d, count(*) AS n, round(sum(len), 2) AS len_m, round(sum(len) / sum(len / (10 + len / 20)), 5) AS v_harm FROM l WHERE grid_d IS NOT NULL GROUP BY ALL")
def piece_links(spark, sf_dir):
    """Links between the cells that lines pass one after the other, with a harmonic speed."""
    link = N.piece_links(pieces(spark, sf_dir), "vec_id")
    v = F.sum("len") / F.sum(F.col("len") / (10 + F.col("len") / 20))
    return link.groupBy("grid_o", "grid_d").agg(F.count("*").alias("n"), F.round(F.sum("len"), 2).alias("len_m"), F.round(v, 5).alias("v_harm"))


@query("clipped_parts", f"WITH {PIECES} SELECT vec_id, count(*) AS parts, round(min(start), 3) AS first_s, round(sum(len), 3) AS len_m FROM pieces WHERE i = 0 AND j = 0 GROUP BY 1")
def clipped_parts(spark, sf_dir):
    """Lines clipped to an area, here the cell from 0 to 150."""
    return pieces(spark, sf_dir).where("i = 0 AND j = 0").groupBy("vec_id").agg(F.count("*").alias("parts"), F.round(F.min("start"), 3).alias("first_s"), F.round(F.sum(G.distance(F.col("a"), F.col("b"))), 3).alias("len_m"))


@query("node_bearings", f"WITH {VERT}, e AS (SELECT vec_id, max(x) FILTER (k = 0) AS x0, max(y) FILTER (k = 0) AS y0, max(x) FILTER (k = 1) AS x1, max(y) FILTER (k = 1) AS y1, max(x) FILTER (k = 31) AS x2, max(y) FILTER (k = 31) AS y2, max(x) FILTER (k = 30) AS x3, max(y) FILTER (k = 30) AS y3 FROM v GROUP BY 1) SELECT vec_id, round((degrees(atan2(y1 - y0, x1 - x0)) + 360) % 360, 6) AS at_u, round((degrees(atan2(y3 - y2, x3 - x2)) + 360) % 360, 6) AS at_v FROM e")
def node_bearings(spark, sf_dir):
    """G04."""
    g = F.col("geom")
    return lines(spark, sf_dir).select("vec_id", F.round(N.node_bearing(g, False), 6).alias("at_u"), F.round(N.node_bearing(g, True), 6).alias("at_v"))


@query("snapped_lines", f"WITH {SEG}, e AS (SELECT vec_id, round(max(ax) FILTER (k = 0) / 50) * 50 AS x0, round(max(ay) FILTER (k = 0) / 50) * 50 AS y0, round(max(bx) FILTER (k = 30) / 50) * 50 AS x1, round(max(byy) FILTER (k = 30) / 50) * 50 AS y1 FROM s GROUP BY 1), n AS (SELECT s.vec_id, CASE k WHEN 0 THEN sqrt((bx - x0) ** 2 + (byy - y0) ** 2) WHEN 30 THEN sqrt((x1 - ax) ** 2 + (y1 - ay) ** 2) ELSE len END AS len FROM s JOIN e USING (vec_id)) SELECT vec_id, round(sum(len), 4) AS length_m FROM n GROUP BY 1")
def snapped_lines(spark, sf_dir):
    """End points drawn to the nearest node of a raster of 50, and what that makes of the length."""
    near = lambda p: G.point(F.round(p.getField("x") / 50) * 50, F.round(p.getField("y") / 50) * 50)
    g = F.col("geom")
    return lines(spark, sf_dir).select("vec_id", F.round(G.length(G.snapped(g, near(F.get(g, F.lit(0))), near(F.element_at(g, -1)))), 4).alias("length_m"))


@query("exploded_parts", f"WITH {VERT} SELECT vec_id, CAST(k // 8 AS INTEGER) AS part, count(*) AS n, round(min(x), 4) AS xmin FROM v WHERE NOT (vec_id % 3 = 0 AND k // 8 = 1) GROUP BY ALL")
def exploded_parts(spark, sf_dir):
    """Multi-part texts as single lines; empty parts are dropped, the others keep their number."""
    part = lambda k: F.transform(F.slice("geom", 8 * k + 1, 8), lambda p: F.concat_ws(" ", p.getField("x").cast("string"), p.getField("y").cast("string")))
    text = F.concat_ws("|", *[F.when((F.col("vec_id") % 3 == 0) & F.lit(k == 1), "LINESTRING EMPTY").otherwise(F.concat(F.lit("LINESTRING ("), F.array_join(part(k), ", "), F.lit(")"))) for k in range(4)])
    from roadloom.functions.columns import wkt_points

    each = lines(spark, sf_dir).select("vec_id", F.posexplode(F.split(text, r"\|")).alias("part", "wkt")).select("vec_id", "part", wkt_points(F.col("wkt")).alias("g")).where("g IS NOT NULL")
    return each.select("vec_id", "part", F.size("g").cast("long").alias("n"), F.round(G.bounds(F.col("g")).getField("xmin"), 4).alias("xmin"))


@query("split_needed", f"WITH {VERT}, pts AS (SELECT vec_id, k, x, y FROM v WHERE k % 4 = 0), n AS (SELECT vec_id, k, CAST(floor(x / 400 + 0.5) AS BIGINT) * 1000 + CAST(floor(y / 400 + 0.5) AS BIGINT) AS nearest, sqrt(x * x + y * y) <= 20 AS major FROM pts), g AS (SELECT vec_id, count(DISTINCT nearest) > 1 AS changes, bool_or(major) AS hit FROM n GROUP BY 1) SELECT vec_id, changes OR hit AS need_split FROM g")
def split_needed(spark, sf_dir):
    """Lines whose sampled vertices are nearest to different corridors (cells here), or that pass a major node (the origin)."""
    p = lines(spark, sf_dir).select("vec_id", F.posexplode("geom").alias("k", "p")).where("k % 4 = 0").select("vec_id", "p.x", "p.y")
    near = (F.floor(F.col("x") / 400 + 0.5) * 1000 + F.floor(F.col("y") / 400 + 0.5)).alias("nearest")
    return needs_split(p.select("vec_id", near), "vec_id", "nearest", p.where(F.hypot("x", "y") <= 20).select("vec_id"))


TOPO = """topo AS (SELECT event_id AS edge, event_id // 4 AS u, 1000000 + event_id * 3 % 500 AS v, event_id // 4 * 2 + event_id % 2 AS road, CASE WHEN event_id // 4 % 5 = 0 THEN 'same' ELSE 'road ' || event_id % 2 END AS name, event_id // 4 % 7 = 0 AS junction,
 ((event_id // 4 * 37 + 90 * (event_id % 4) + value / 100) % 360 + 360) % 360 AS bearing FROM events)"""


def topo(spark, sf_dir):
    """Four edges an event node: two roads that cross about at right angles; the other ends are shared."""
    e, id4 = F.col("event_id"), F.floor(F.col("event_id") / 4)
    name = F.when(id4 % 5 == 0, "same").otherwise(F.concat(F.lit("road "), (e % 2).cast("string")))
    return table(spark, sf_dir, "events").select(e.alias("edge"), id4.alias("u"), (1000000 + e * 3 % 500).alias("v"), (id4 * 2 + e % 2).alias("road"), name.alias("name"), (id4 % 7 == 0).alias("junction"), F.pmod(id4 * 37 + 90 * (e % 4) + F.col("value") / 100, F.lit(360.0)).alias("bearing"))


SUSPICIOUS = TOPO + """, r AS (SELECT u AS node, road, count(*) AS n, min(bearing) AS lo, max(bearing) AS hi, min(name) AS name, bool_and(junction) AS junction FROM topo GROUP BY ALL), a AS (SELECT *, abs(((lo - hi + 180) % 360 + 360) % 360 - 180) AS angle FROM r),
g AS (SELECT node, sum(n) AS degree, count(*) AS roads, min(n) AS least, min(angle) AS min_angle, max(angle) AS max_angle, min(name) = max(name) AS same_name, bool_and(junction) AS both_junction FROM a GROUP BY 1),
odd AS (SELECT node, min_angle, max_angle, same_name, both_junction, CASE WHEN min_angle >= 178 AND NOT same_name AND NOT both_junction THEN 'high' WHEN min_angle >= 178 THEN 'medium' ELSE 'low' END AS confidence FROM g WHERE degree = 4 AND roads = 2 AND least = 2 AND min_angle >= 150 AND node % 11 <> 0)"""


def crossings(spark, sf_dir):
    t = topo(spark, sf_dir)
    return N.suspicious_crossings(t.withColumnRenamed("u", "node"), t.where("u % 11 = 0").select(F.col("u").alias("node")))


@query("suspicious_nodes", f"WITH {SUSPICIOUS} SELECT node, round(min_angle, 6) AS min_angle, round(max_angle, 6) AS max_angle, same_name, both_junction, confidence FROM odd")
def suspicious_nodes(spark, sf_dir):
    """R14."""
    return rounded(crossings(spark, sf_dir))


@query("suspicious_atlas", f"WITH {SUSPICIOUS} SELECT node, confidence, round(min_angle, 6) AS min_angle FROM odd ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, round(min_angle, 6) DESC, node LIMIT 12")
def suspicious_atlas(spark, sf_dir):
    """A top-12 report of the crossings to look at first."""
    first = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return rounded(crossings(spark, sf_dir).select("node", "confidence", "min_angle")).orderBy(first, F.desc("min_angle"), "node").limit(12)


@query("refined_edges", f"WITH {SUSPICIOUS}, top AS (SELECT greatest(max(u), max(v)) AS top FROM topo), ends AS (SELECT DISTINCT node, road FROM (SELECT u AS node, road FROM topo UNION ALL SELECT v, road FROM topo) JOIN odd USING (node) WHERE confidence = 'high'), cl AS (SELECT node, road, top + row_number() OVER (ORDER BY node, road) AS clone FROM ends, top) SELECT edge, t.road, coalesce(a.clone, u) AS u, coalesce(b.clone, v) AS v FROM topo t LEFT JOIN cl a ON a.node = u AND a.road = t.road LEFT JOIN cl b ON b.node = v AND b.road = t.road")
def refined_edges(spark, sf_dir):
    """Crossings of high confidence taken apart, a node for each road."""
    return N.split_nodes(topo(spark, sf_dir).select("edge", "road", "u", "v"), crossings(spark, sf_dir))


@query("endpoint_nodes", f"WITH {TOPO} SELECT edge, u, v FROM topo")
def endpoint_nodes(spark, sf_dir):
    """End points in rows, 0 and 1, as columns again."""
    t = topo(spark, sf_dir)
    ends = t.select("edge", F.posexplode(F.array("u", "v")).alias("idx", "node"))
    return N.endpoint_table(ends, "edge", "idx", "node")


@query("topology_summary", f"WITH RECURSIVE {REACH}, c AS (SELECT component, count(*) AS n FROM comp GROUP BY 1), d AS (SELECT node, count(*) AS degree FROM (SELECT grid_o AS node FROM edges UNION ALL SELECT grid_d FROM edges) GROUP BY 1), big AS (SELECT component FROM c ORDER BY n DESC, component LIMIT 1) SELECT (SELECT count(*) FROM comp) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM c) AS n_components, (SELECT max(n) FROM c) AS largest, (SELECT component FROM big) AS largest_id, (SELECT count(*) FROM d WHERE degree = 1) AS dead_ends, (SELECT count(*) FROM edges WHERE grid_o = grid_d) AS self_loops")
def topology_summary(spark, sf_dir):
    """Size of the graph, its largest component, dead ends and loops."""
    e = grid_edges(spark, sf_dir)
    c = components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n"))
    of = c.agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_components"), F.max("n").alias("largest"), (-F.max(F.struct("n", (-F.col("component")).alias("c"))).getField("c")).alias("largest_id"))
    degree = Gr.degrees(e, "grid_o", "grid_d").agg(F.count_if(F.col("degree") == 1).alias("dead_ends"))
    edges = e.agg(F.count("*").alias("n_edges"), F.count_if(F.col("grid_o") == F.col("grid_d")).alias("self_loops"))
    return of.join(F.broadcast(degree)).join(F.broadcast(edges))  # three rows of one each


@query("directed_edges", "SELECT o_orderkey AS edge_id, o_custkey AS from_node_id, a.c_custkey AS to_node_id, f.c_name AS from_name, a.c_name AS to_name, round(abs(f.c_acctbal - a.c_acctbal), 2) AS length_m, CASE WHEN o_orderstatus = 'F' THEN 'AB' ELSE 'BA' END AS dir FROM orders JOIN customer f ON f.c_custkey = o_custkey JOIN customer a ON a.c_custkey = o_orderkey % 97 + 1 WHERE o_custkey <> a.c_custkey")
def directed_edges(spark, sf_dir):
    """A directed edge for each segment, with its nodes' attributes; loops are dropped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("from_node_id"), (F.col("o_orderkey") % 97 + 1).alias("to_node_id"), F.when(F.col("o_orderstatus") == "F", "AB").otherwise("BA").alias("dir"))
    node = lambda end: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(f"{end}_node_id"), F.col("c_name").alias(f"{end}_name"), F.col("c_acctbal").alias(f"_{end}"))
    both = o.where("from_node_id <> to_node_id").join(node("from"), "from_node_id").join(node("to"), "to_node_id")
    return both.select("edge_id", "from_node_id", "to_node_id", "from_name", "to_name", F.round(F.abs(F.col("_from") - F.col("_to")), 2).alias("length_m"), "dir")


@query("connector_speeds", "WITH s AS (SELECT o_custkey AS node_id, o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey % 97 + 1, o_totalprice FROM orders), m AS (SELECT node_id, median(v) AS v FROM s GROUP BY 1) SELECT c_custkey AS node_id, round(CASE WHEN v > 0 THEN v ELSE 25.0 END, 4) AS local_speed_kmh FROM customer LEFT JOIN m ON node_id = c_custkey")
def connector_speeds(spark, sf_dir):
    """Median speed of the edges at each node, a fallback where there are none. The exact median keeps a node's distinct values together: a node has few edges."""
    o = table(spark, sf_dir, "orders")
    s = o.select(F.explode(F.array("o_custkey", F.col("o_orderkey") % 97 + 1)).alias("node_id"), F.col("o_totalprice").alias("v"))
    m = s.groupBy("node_id").agg(F.median("v").alias("v"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))
    return c.join(m, "node_id", "left").select("node_id", F.round(F.when(F.col("v") > 0, F.col("v")).otherwise(25.0), 4).alias("local_speed_kmh"))


@query("lineage", "WITH p AS (SELECT event_id AS piece, event_id % 200 AS cline, value AS lo, value + 10 + event_id % 30 AS hi FROM events), s AS (SELECT p_partkey AS source, p_partkey % 200 AS cline, p_retailprice % 490 AS lo, p_retailprice % 490 + p_size AS hi FROM part), o AS (SELECT piece, source, least(p.hi, s.hi) - greatest(p.lo, s.lo) AS o FROM p JOIN s ON p.cline = s.cline AND s.lo < p.hi AND p.lo < s.hi), b AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY o DESC, source) AS rn FROM o) SELECT p.piece, source, round(coalesce(o, 0), 6) AS source_overlap_m FROM p LEFT JOIN b ON b.piece = p.piece AND rn = 1")
def lineage(spark, sf_dir):
    """J20."""
    p = table(spark, sf_dir, "events").select(F.col("event_id").alias("piece"), (F.col("event_id") % 200).alias("cline"), F.col("value").alias("lo"), (F.col("value") + 10 + F.col("event_id") % 30).alias("hi"))
    at = F.col("p_retailprice") % 490
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") % 200).alias("cline"), at.alias("lo"), (at + F.col("p_size")).alias("hi"))
    return rounded(N.lineage(p, s, "cline", "piece", "source", 25.0))


@query("tessellation_stats", "WITH p AS (SELECT value * 100 AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 100 AS y FROM events), c AS (SELECT floor(x / 3000) AS i, floor(y / 3000) AS j, count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) / 1e6 AS used FROM p GROUP BY ALL) SELECT count(*) AS n_cells, 9.0::DOUBLE AS mean_km2, round(avg(n), 6) AS mean_points, max(n) AS most_points, round(avg(used / 9), 6) AS used_share FROM c")
def tessellation_stats(spark, sf_dir):
    """TS5: number of cells, mean area and what lies in them."""
    e = table(spark, sf_dir, "events").select((F.col("value") * 100).alias("x"), (F.get_json_object("props", "$.k").try_cast("double") * 100).alias("y"))
    span = lambda c: F.max(c) - F.min(c)
    c = e.groupBy(F.floor(F.col("x") / 3000).alias("i"), F.floor(F.col("y") / 3000).alias("j")).agg(F.count("*").alias("n"), (span("x") * span("y") / 1e6).alias("used"))
    return c.agg(F.count("*").alias("n_cells"), F.lit(9.0).alias("mean_km2"), F.round(F.avg("n"), 6).alias("mean_points"), F.max("n").alias("most_points"), F.round(F.avg(F.col("used") / 9), 6).alias("used_share"))


@query("farthest_members", f"WITH {VERT}{NEARS}, a AS (SELECT seg_id, arg_min(cline_id, struct_pack(a := dist, b := cline_id)) AS seed, min(dist) AS dist FROM p WHERE dist <= 150 GROUP BY 1), g AS (SELECT seed, count(*) AS n, arg_max(seg_id, struct_pack(a := dist, b := -seg_id)) AS seg_id, max(dist) AS dist FROM a GROUP BY 1) SELECT seed, n, seg_id, round(dist, 4) AS dist FROM g ORDER BY n DESC, seed LIMIT 10")
def farthest_members(spark, sf_dir):
    """A top-10 report of the fullest cells and the member that would be their next seed."""
    a, b = first_points(spark, sf_dir)
    near = S.nearest(S.within_distance(a, b, "seg_id", "cline_id", 150.0), "seg_id", "cline_id", 1).withColumnRenamed("cline_id", "seed")
    return N.farthest_members(near, "seed", "seg_id", 10).select("seed", "n", "seg_id", F.round("dist", 4).alias("dist"))


@query("voronoi_polygons")
def voronoi_polygons(spark, sf_dir):
    """TS4, G36: finite cells of the corridors' first points, with their area and number of corners."""
    _, seeds = first_points(spark, sf_dir)
    ring = N.voronoi_polygons(seeds, "cline_id", 400.0).select("cline_id", N.repaired(F.col("ring")).alias("ring"))
    return ring.select("cline_id", F.size("ring").alias("corners"), F.round(G.signed_area(F.col("ring")), 4).alias("area"))


@query("source_tags", "SELECT p_partkey, CASE WHEN p_type LIKE 'S%' THEN 'geometry' ELSE 'semantic' END AS dir_source, p_size > 5 AS is_valid, p_size > 5 AND p_retailprice > 1000 AS keep_baseline, p_type NOT LIKE 'S%' AS keep_semantic FROM part")
def source_tags(spark, sf_dir):
    """Where a direction comes from, validity and keep flags. Types that begin with S stand for roads without a description."""
    text = F.when(~F.col("p_type").startswith("S"), "东向西")
    deg = direction_degrees(text)
    ok = F.col("p_size") > 5
    return table(spark, sf_dir, "part").select("p_partkey", F.when(deg.isNotNull(), "semantic").otherwise("geometry").alias("dir_source"), ok.alias("is_valid"), (ok & (F.col("p_retailprice") > 1000)).alias("keep_baseline"), deg.isNotNull().alias("keep_semantic"))


@query("harmonised_columns", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE o_orderpriority END AS road_class FROM orders")
def harmonised_columns(spark, sf_dir):
    """Columns that a join told twice, `_x` and `_y`, as one again."""
    o = table(spark, sf_dir, "orders")
    left, right = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("road_class")), o.select("o_orderkey", F.col("o_orderpriority").alias("road_class"))
    return R.harmonised(R.suffixed_join(left, right, "o_orderkey"))


@query("text_columns", "SELECT p_partkey, upper(trim(p_name)) AS name, lower(p_brand) AS brand, starts_with(p_type, 'S') AS is_s, substr(p_type, 2, 3) AS part, CAST(p_size AS VARCHAR) AS size_text FROM part")
def text_columns(spark, sf_dir):
    """P19."""
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("name"), F.lower("p_brand").alias("brand"), c("p_type").startswith("S").alias("is_s"), F.substring("p_type", 2, 3).alias("part"), c("p_size").cast("string").alias("size_text"))


@query("number_list", "SELECT * FROM (VALUES (1, 0, 0.05::DOUBLE), (1, 1, 0.15), (2, 0, 5), (2, 1, 10), (2, 2, 20)) AS t(i, k, v)")
def number_list(spark, sf_dir):
    """Blanks and texts that are no number are passed over."""
    d = spark.sql("SELECT * FROM VALUES (1, '0.05, 0.15'), (2, '5,10,,x,20 '), (3, ''), (4, NULL) AS t(i, s)")
    return d.select("i", F.posexplode(R.number_list(F.col("s"))).alias("k", "v"))


@query("bbox_filter", "SELECT event_id FROM events WHERE value BETWEEN 115.4 AND 117.5 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 39.4 AND 90")
def bbox_filter(spark, sf_dir):
    """P31."""
    lat = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf_dir, "events").where(F.col("value").between(115.4, 117.5) & lat.between(39.4, 90)).select("event_id")


@query("one_to_one", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def one_to_one(spark, sf_dir):
    """J07."""
    c = table(spark, sf_dir, "customer")
    return R.checked_one_to_one(c.select("c_custkey", "c_name"), c.select("c_custkey", "c_nationkey"), "c_custkey")


@query("optional_flags", "SELECT o_orderkey, o_orderstatus = 'F' AS keep FROM orders WHERE o_orderstatus = 'F'")
def optional_flags(spark, sf_dir):
    """A flag that is there filters, one that is not keeps all."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("keep"))
    return R.optional_flag(R.optional_flag(o, "keep"), "no_such_flag")


@query("native_pairs", f"WITH {MATCH}, pre AS (SELECT o_orderkey AS l_orderkey, min(l_linenumber) AS l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1) SELECT m.l_orderkey, m.l_linenumber, m.cline_id, CASE WHEN pre.l_orderkey IS NOT NULL THEN 'outer_native' ELSE method END AS method, CASE WHEN pre.l_orderkey IS NOT NULL THEN 999.0::DOUBLE ELSE round(share, 4) END AS score, count(*) AS n FROM m LEFT JOIN pre USING (l_orderkey, l_linenumber) GROUP BY ALL")
def native_pairs(spark, sf_dir):
    """Rows that are linked beforehand bypass the matching, with a score of 999."""
    m = matches(spark, sf_dir)
    own = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    pre = m.join(own, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber")).withColumn("_pre", F.lit(True))
    j = m.join(pre, ["l_orderkey", "l_linenumber"], "left")
    linked = F.col("_pre").isNotNull()
    out = j.select("l_orderkey", "l_linenumber", "cline_id", F.when(linked, "outer_native").otherwise(F.col("method")).alias("method"), F.when(linked, 999.0).otherwise(F.round("share", 4)).alias("score"))
    return out.groupBy(out.columns).agg(F.count("*").alias("n"))


@query("projection_rerun", f"WITH {MATCH} SELECT method, CASE WHEN method = 'projection_fallback' AND share < 0.04 THEN 'unmatched' ELSE method END AS method_new, count(*) AS n, round(sum(span), 4) AS span FROM m GROUP BY ALL")
def projection_rerun(spark, sf_dir):
    """A saved version of the matches, of which only the projected rows are judged anew, by a stricter share."""
    saved = stored(matches(spark, sf_dir))
    anew = saved.where("method = 'projection_fallback'").withColumn("method_new", F.when(F.col("share") < 0.04, "unmatched").otherwise(F.col("method")))
    rest = saved.where("method <> 'projection_fallback'").withColumn("method_new", F.col("method"))
    return rest.unionByName(anew).groupBy("method", "method_new").agg(F.count("*").alias("n"), F.round(F.sum("span"), 4).alias("span"))


@query("match_map", f"WITH {VERT}, c AS (SELECT vec_id, sqrt(x * x + y * y) AS d FROM v WHERE k = 0) SELECT CASE WHEN vec_id % 3 = 0 THEN 'unmatched' ELSE 'matched' END AS status, roi, count(*) AS n FROM c, (VALUES ('full', 1e9), ('roi', 150)) AS t(roi, r) WHERE d <= r GROUP BY ALL")
def match_map(spark, sf_dir):
    """matched and unmatched lines on the whole map and within a radius."""
    p = lines(spark, sf_dir).select("vec_id", G.distance(F.get("geom", F.lit(0)), G.point(F.lit(0.0), F.lit(0.0))).alias("d"))
    maps = F.explode(F.array(F.lit("full"), F.when(F.col("d") <= 150, "roi"))).alias("roi")
    each = p.select(F.when(F.col("vec_id") % 3 == 0, "unmatched").otherwise("matched").alias("status"), maps).where("roi IS NOT NULL")
    return each.groupBy("status", "roi").agg(F.count("*").alias("n"))


@query("grid_types", "WITH e AS (SELECT value * 100 AS x FROM events) SELECT 'square' AS grid_type, CAST(floor(x / 3000) AS BIGINT) AS cell, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'fine', CAST(floor(x / 1000) AS BIGINT), count(*) FROM e GROUP BY ALL")
def grid_types(spark, sf_dir):
    """O2: one table for all kinds of grid."""
    x = table(spark, sf_dir, "events").select((F.col("value") * 100).alias("x"))
    return by_grid_type({k: x.groupBy(F.floor(F.col("x") / size).alias("cell")).agg(F.count("*").alias("n")) for k, size in (("square", 3000), ("fine", 1000))}).select("grid_type", "cell", "n")


@query("grid_time_comparison", f"WITH {EDGES}, n AS (SELECT grid_o, grid_d, t_min, t_min * (0.8 + (grid_o + 2 * grid_d) % 5 * 0.1) AS t_old FROM edges WHERE (grid_o + grid_d) % 6 > 0) SELECT count(*) AS n_pairs, round(avg(t_min / t_old), 6) AS mean_ratio, round(median(t_min / t_old), 6) AS median_ratio, count(*) FILTER (t_min > t_old) AS slower, round(corr(t_min, t_old), 6) AS corr FROM n")
def grid_time_comparison(spark, sf_dir):
    """Times from the road graph against an older table, on the pairs that both have."""
    e = grid_edges(spark, sf_dir)
    old = e.where((F.col("grid_o") + F.col("grid_d")) % 6 > 0).select("grid_o", "grid_d", (F.col("t_min") * (0.8 + (F.col("grid_o") + 2 * F.col("grid_d")) % 5 * 0.1)).alias("t_old"))
    j = e.join(old, ["grid_o", "grid_d"]).withColumn("r", F.col("t_min") / F.col("t_old"))
    return j.agg(F.count("*").alias("n_pairs"), F.round(F.avg("r"), 6).alias("mean_ratio"), F.round(F.median("r"), 6).alias("median_ratio"), F.count_if(F.col("t_min") > F.col("t_old")).alias("slower"), F.round(F.corr("t_min", "t_old"), 6).alias("corr"))
