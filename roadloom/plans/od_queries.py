"""Commuting flows, grids' tables, lanes, matching tables and summaries on the proxies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadloom.functions.columns import grid_id, percent_text, ratio, symmetric_ratio
from roadloom.operators import relational as R
from roadloom.operators.panel import weighted_mean
from roadloom.plans import query
from roadloom.plans.panel_queries import OBS, PANEL, observations, panel, rounded
from roadloom.sources.tables import table

MODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NAMES = ["type_walk", "type_bike", "type_sub", "type_bus", "type_car"]


def trips(spark, sf_dir):
    """Trips between nations: home of the customer, work of the supplier, one of five modes. The dimensions join by broadcast, the orders by key."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("home_grid"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("work_grid"))
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey).join(cust, orders.o_custkey == cust.c_custkey).join(supp, li.l_suppkey == supp.s_suppkey)
    return joined.select("home_grid", "work_grid", F.col("l_quantity").alias("pop"), "o_orderpriority")


TRIPS = """trips AS (SELECT c_nationkey AS home_grid, s_nationkey AS work_grid, l_quantity AS pop, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
OD = TRIPS + ", od AS (SELECT home_grid, work_grid, sum(pop) AS pop, " + ", ".join(f"coalesce(sum(pop) FILTER (o_orderpriority = '{m}'), 0) AS {n}" for m, n in zip(MODES, NAMES, strict=True)) + " FROM trips GROUP BY ALL)"


def od_matrix(spark, sf_dir):
    """Population and modes by home and work cell; the modes are conditional sums of the same pass."""
    by_mode = [F.sum(F.when(F.col("o_orderpriority") == m, F.col("pop")).otherwise(0.0)).alias(n) for m, n in zip(MODES, NAMES, strict=True)]
    return trips(spark, sf_dir).groupBy("home_grid", "work_grid").agg(F.sum("pop").alias("pop"), *by_mode)


def grid_edges(spark, sf_dir):
    """Directed edges between nations with free-flow minutes; the nations table is fixed at 25 rows."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    o, d = n.select(F.col("k").alias("o")), n.select(F.col("k").alias("d"))
    pairs = o.join(d, (F.col("o") != F.col("d")) & ((5 * F.col("o") + 3 * F.col("d")) % 7 == 0))
    return pairs.select(F.col("o").alias("grid_o"), F.col("d").alias("grid_d"), F.round(1 + F.abs(F.col("o") - F.col("d")) * 0.5 + (F.col("o") * F.col("d") % 5) * 0.25, 3).alias("t_min"))


EDGES = """edges AS (SELECT CAST(a.n_nationkey AS BIGINT) AS grid_o, CAST(b.n_nationkey AS BIGINT) AS grid_d, round(1 + abs(a.n_nationkey - b.n_nationkey) * 0.5::DOUBLE + (a.n_nationkey * b.n_nationkey % 5) * 0.25::DOUBLE, 3) AS t_min
 FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND (5 * a.n_nationkey + 3 * b.n_nationkey) % 7 = 0)"""


@query("od_matrix", f"WITH {OD} SELECT *, type_walk + type_bike + type_sub + type_bus + type_car AS identified, round((type_walk + type_bike + type_sub + type_bus + type_car) / pop, 6) AS identified_share_of_pop FROM od")
def od(spark, sf_dir):
    total = sum((F.col(n) for n in NAMES[1:]), F.col(NAMES[0]))
    return od_matrix(spark, sf_dir).withColumn("identified", total).withColumn("identified_share_of_pop", F.round(ratio(F.col("identified"), F.col("pop")), 6))


@query("mode_share", f"WITH {TRIPS} SELECT o_orderpriority AS mode, sum(pop) AS pop, round(sum(pop) / (SELECT sum(pop) FROM trips), 6) AS share FROM trips GROUP BY 1")
def mode_share(spark, sf_dir):
    """Column totals turned to rows, and their shares."""
    totals = od_matrix(spark, sf_dir).agg(*[F.sum(n).alias(n) for n in NAMES])
    long = totals.select(F.expr(f"stack(5, {', '.join(f'{m!r}, {n}' for m, n in zip(MODES, NAMES, strict=True))}) AS (mode, pop)"))
    return long.withColumn("share", F.round(F.col("pop") / F.sum("pop").over(Window.partitionBy()), 6))


@query("residents_jobs", f"WITH {OD}, r AS (SELECT home_grid AS grid_id, sum(pop) AS residents FROM od GROUP BY 1), j AS (SELECT work_grid AS grid_id, sum(pop) AS jobs FROM od GROUP BY 1) SELECT grid_id, coalesce(residents, 0) AS residents, coalesce(jobs, 0) AS jobs, round(coalesce(jobs, 0) / residents, 6) AS job_resident_ratio FROM r FULL JOIN j USING (grid_id)")
def residents_jobs(spark, sf_dir):
    return rounded(R.home_work_marginals(od_matrix(spark, sf_dir), "home_grid", "work_grid", "pop"))


@query("population_outer", f"WITH {TRIPS}, od AS (SELECT * FROM trips WHERE home_grid < 20 AND work_grid > 4), r AS (SELECT home_grid AS grid_id, sum(pop) AS residents FROM od GROUP BY 1), j AS (SELECT work_grid AS grid_id, sum(pop) AS jobs FROM od GROUP BY 1) SELECT grid_id, coalesce(residents, 0) AS residents, coalesce(jobs, 0) AS jobs, round(coalesce(jobs, 0) / residents, 6) AS job_resident_ratio FROM r FULL JOIN j USING (grid_id)")
def population_outer(spark, sf_dir):
    """Cells that are only homes or only work places stay."""
    return rounded(R.home_work_marginals(trips(spark, sf_dir).where("home_grid < 20 AND work_grid > 4"), "home_grid", "work_grid", "pop"))


@query("residents_percentile", f"WITH {OD}, r AS (SELECT home_grid, sum(pop) AS residents FROM od GROUP BY 1) SELECT home_grid, round((rank() OVER (ORDER BY residents) + (count(*) OVER (PARTITION BY residents) - 1) / 2.0) / count(*) OVER (), 6) AS pct FROM r")
def residents_percentile(spark, sf_dir):
    r = od_matrix(spark, sf_dir).groupBy("home_grid").agg(F.sum("pop").alias("residents"))
    return r.select("home_grid", F.round(R.average_rank("residents"), 6).alias("pct"))


@query("qsm_edges", f"WITH {EDGES} SELECT grid_o, grid_d, t_min, 'square' AS grid_type, 'v1' AS version_id, CAST(row_number() OVER (ORDER BY grid_o, grid_d) - 1 AS INTEGER) AS edge_i FROM edges")
def qsm_edges(spark, sf_dir):
    """Edges with provenance; the number is for display, joins use the cells."""
    return grid_edges(spark, sf_dir).select("*", F.lit("square").alias("grid_type"), F.lit("v1").alias("version_id"), (F.row_number().over(Window.orderBy("grid_o", "grid_d")) - 1).alias("edge_i"))


@query("qsm_nodes", f"WITH {EDGES}, {OD}, ids AS (SELECT grid_o AS g FROM edges UNION SELECT grid_d FROM edges UNION SELECT home_grid FROM od UNION SELECT work_grid FROM od), r AS (SELECT home_grid AS g, sum(pop) AS residents FROM od GROUP BY 1), j AS (SELECT work_grid AS g, sum(pop) AS jobs FROM od GROUP BY 1) SELECT CAST(g AS BIGINT) AS grid_id, CAST(row_number() OVER (ORDER BY CAST(g AS VARCHAR)) - 1 AS INTEGER) AS node_i, coalesce(residents, 0) AS residents, coalesce(jobs, 0) AS jobs FROM ids LEFT JOIN r USING (g) LEFT JOIN j USING (g)")
def qsm_nodes(spark, sf_dir):
    """One numbering, by the ids' text order, for all tables (survey T1)."""
    e, o = grid_edges(spark, sf_dir), od_matrix(spark, sf_dir)
    ids = e.select(F.col("grid_o").alias("grid_id")).union(e.select("grid_d")).union(o.select(F.col("home_grid").cast("long"))).union(o.select(F.col("work_grid").cast("long"))).distinct()
    numbered = ids.withColumn("node_i", F.row_number().over(Window.orderBy(F.col("grid_id").cast("string"))) - 1)
    pop = R.home_work_marginals(o.select(F.col("home_grid").cast("long").alias("h"), F.col("work_grid").cast("long").alias("w"), "pop"), "h", "w", "pop")
    return numbered.join(pop, "grid_id", "left").select("grid_id", "node_i", F.coalesce("residents", F.lit(0.0)).alias("residents"), F.coalesce("jobs", F.lit(0.0)).alias("jobs"))


@query("square_grid", "SELECT event_id, 'sq_' || CAST(floor(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 100 / 3000) AS BIGINT) || '_' || CAST(floor(value * 100 / 3000) AS BIGINT) AS grid_id FROM events")
def square_grid(spark, sf_dir):
    """TS1, J11: the cell of a square grid is arithmetic on the point, so no join is needed."""
    x, y = F.col("value") * 100, F.get_json_object("props", "$.k").try_cast("double") * 100
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("sq_"), F.floor(y / 3000), F.lit("_"), F.floor(x / 3000)).alias("grid_id"))


@query("square_cells", "WITH p AS (SELECT value * 100 AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 100 AS y FROM events), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p) SELECT 'sq_' || r || '_' || c AS grid_id, round(x0 + c * 3000, 6) AS xmin, round(y0 + r * 3000, 6) AS ymin, 9.0::DOUBLE AS area_km2 FROM b, LATERAL unnest(range(0, CAST(ceil((y1 - y0) / 3000) AS BIGINT))) AS t(r), LATERAL unnest(range(0, CAST(ceil((x1 - x0) / 3000) AS BIGINT))) AS u(c)")
def square_cells(spark, sf_dir):
    """TS1: all cells of the bounding box, row by row; one row of bounds explodes into them."""
    p = table(spark, sf_dir, "events").select((F.col("value") * 100).alias("x"), (F.get_json_object("props", "$.k").try_cast("double") * 100).alias("y"))
    b = p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    steps = lambda a, z: F.sequence(F.lit(0).cast("long"), F.ceil((F.col(z) - F.col(a)) / 3000) - 1)
    cells = b.select("*", F.explode(steps("y0", "y1")).alias("r")).select("*", F.explode(steps("x0", "x1")).alias("c"))
    return cells.select(F.concat(F.lit("sq_"), "r", F.lit("_"), "c").alias("grid_id"), F.round(F.col("x0") + F.col("c") * 3000, 6).alias("xmin"), F.round(F.col("y0") + F.col("r") * 3000, 6).alias("ymin"), F.lit(9.0).alias("area_km2"))


@query("crs_guess", "SELECT avg((value BETWEEN -180 AND 180 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN -90 AND 90)::INT) > 0.95 AS is_lonlat, round(avg((value BETWEEN -180 AND 180)::INT), 6) AS share FROM events")
def crs_guess(spark, sf_dir):
    """Whether over 95 hundredths of the points fit longitude and latitude."""
    x, y = F.col("value"), F.get_json_object("props", "$.k").try_cast("double")
    inside = x.between(-180, 180) & y.between(-90, 90)
    return table(spark, sf_dir, "events").agg((F.avg(inside.cast("int")) > 0.95).alias("is_lonlat"), F.round(F.avg(x.between(-180, 180).cast("int")), 6).alias("share"))


# Lanes. Lanes of road classes 2, 3 and 4.
LANES = {2: 6.0, 3: 4.0, 4: 2.0}
LANE = """lane AS (SELECT l_partkey % 100 AS cline_id, CASE WHEN l_linestatus = 'O' THEN 'AB' ELSE 'BA' END AS dir, l_quantity * 10 AS len, l_returnflag = 'R' AS is_proj,
 CASE p_size % 5 + 1 WHEN 2 THEN 6.0::DOUBLE WHEN 3 THEN 4.0 WHEN 4 THEN 2.0 END AS lane FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N'),
lw AS (SELECT cline_id, dir, count(*) AS n_matched, count(*) FILTER (is_proj) AS n_proj, avg(lane) AS lane_raw, sum(lane * len) / sum(len) AS lane_len,
 sum(lane * len) FILTER (NOT is_proj) / sum(len) FILTER (NOT is_proj) AS lane_old, sum(lane * len) FILTER (is_proj) / sum(len) FILTER (is_proj) AS lane_proj, coalesce(sum(len) FILTER (is_proj), 0) / sum(len) AS proj_share FROM lane WHERE lane IS NOT NULL AND len > 0 GROUP BY ALL),
opp AS (SELECT cline_id, max(lane_len) FILTER (dir = 'AB') AS ab, max(lane_len) FILTER (dir = 'BA') AS ba FROM lw GROUP BY 1)"""


def lane_rows(spark, sf_dir):
    """Lanes of matched segments by road class; the class map is a CASE, the parts join by key."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("road_class"))
    lane = F.lit(None).cast("double")
    for k, v in LANES.items():
        lane = F.when(F.col("road_class") == k, v).otherwise(lane)
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    return li.join(part, li.l_partkey == part.p_partkey).select((F.col("l_partkey") % 100).alias("cline_id"), F.when(F.col("l_linestatus") == "O", "AB").otherwise("BA").alias("dir"), (F.col("l_quantity") * 10).alias("len"), (F.col("l_returnflag") == "R").alias("is_proj"), lane.alias("lane"))


def lanes(spark, sf_dir):
    """Plain and length-weighted lanes, split by matching method, in one pass."""
    rows = lane_rows(spark, sf_dir).where("lane IS NOT NULL AND len > 0")
    n, w, p = F.col("lane"), F.col("len"), F.col("is_proj")
    mean = lambda ok: ratio(F.sum(F.when(ok, n * w)), F.sum(F.when(ok, w)))
    return rows.groupBy("cline_id", "dir").agg(F.count("*").alias("n_matched"), F.count_if(p).alias("n_proj"), F.avg(n).alias("lane_raw"), mean(F.lit(True)).alias("lane_len"), mean(~p).alias("lane_old"), mean(p).alias("lane_proj"), (F.coalesce(F.sum(F.when(p, w)), F.lit(0.0)) / F.sum(w)).alias("proj_share"))


@query("lane_weighted", f"WITH {LANE} SELECT cline_id, dir, n_matched, n_proj, round(lane_raw, 6) AS lane_raw, round(lane_len, 6) AS lane_len, round(lane_old, 6) AS lane_old, round(lane_proj, 6) AS lane_proj, round(proj_share, 6) AS proj_share FROM lw")
def lane_weighted(spark, sf_dir):
    return rounded(lanes(spark, sf_dir))


@query("lane_opposite", f"WITH {LANE} SELECT cline_id, round(ab - ba, 6) AS diff, round(greatest(ab, ba) / least(ab, ba), 6) AS lane_ratio, CASE WHEN greatest(ab, ba) / least(ab, ba) <= 1.5 THEN 1 ELSE 0 END AS symmetry_flag FROM opp")
def lane_opposite(spark, sf_dir):
    """Difference and ratio of the two directions' lanes, flag 0 where one is missing."""
    two = lanes(spark, sf_dir).groupBy("cline_id").pivot("dir", ["AB", "BA"]).agg(F.first("lane_len"))
    a, b = F.col("AB"), F.col("BA")
    r = F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))
    return two.select("cline_id", F.round(a - b, 6).alias("diff"), F.round(r, 6).alias("lane_ratio"), F.when(r <= 1.5, 1).otherwise(0).alias("symmetry_flag"))


@query("lane_map", "SELECT p_size % 5 + 1 AS road_class, CASE p_size % 5 + 1 WHEN 2 THEN 6.0::DOUBLE WHEN 3 THEN 4.0 WHEN 4 THEN 2.0 END AS lane, count(*) AS n FROM part GROUP BY ALL")
def lane_map(spark, sf_dir):
    lane = F.lit(None).cast("double")
    for k, v in LANES.items():
        lane = F.when(F.col("road_class") == k, v).otherwise(lane)
    return table(spark, sf_dir, "part").select((F.col("p_size") % 5 + 1).alias("road_class")).select("road_class", lane.alias("lane")).groupBy("road_class", "lane").agg(F.count("*").alias("n"))


# Matching: every line item is a segment, old matches are A, projections R.
MATCH = """m AS (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS cline_id, CASE WHEN l_linestatus = 'O' THEN 'AB' ELSE 'BA' END AS dir, CASE l_returnflag WHEN 'A' THEN 'baseline_old' WHEN 'R' THEN 'projection_fallback' ELSE 'unmatched' END AS method, l_quantity AS span, l_discount AS share, l_extendedprice / 1000 AS apl FROM lineitem)"""


def matches(spark, sf_dir):
    """Priority of the old match over the projection, by CASE."""
    method = F.when(F.col("l_returnflag") == "A", "baseline_old").when(F.col("l_returnflag") == "R", "projection_fallback").otherwise("unmatched")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 100).alias("cline_id"), F.when(F.col("l_linestatus") == "O", "AB").otherwise("BA").alias("dir"), method.alias("method"), F.col("l_quantity").alias("span"), F.col("l_discount").alias("share"), (F.col("l_extendedprice") / 1000).alias("apl"))


@query("match_rates", f"WITH {MATCH}, per_edge AS (SELECT l_orderkey, max((method <> 'unmatched')::INT) AS hit FROM m GROUP BY 1) SELECT (SELECT round(avg((method <> 'unmatched')::INT), 6) FROM m) AS split_rate, round(avg(hit), 6) AS edge_rate, count(*) AS n_edges FROM per_edge")
def match_rates(spark, sf_dir):
    """Any match of an edge counts for the edge; the rate by split comes from the same sums."""
    hit = (F.col("method") != "unmatched").cast("int")
    e = matches(spark, sf_dir).groupBy("l_orderkey").agg(F.max(hit).alias("hit"), F.sum(hit).alias("h"), F.count("*").alias("n"))
    return e.agg(F.round(F.sum("h") / F.sum("n"), 6).alias("split_rate"), F.round(F.avg("hit"), 6).alias("edge_rate"), F.count("*").alias("n_edges"))


@query("match_flags", f"WITH {MATCH} SELECT method, (method = 'projection_fallback' AND (apl > 60 OR share < 0.05))::INT AS review_flag, count(*) AS n, round(sum(span), 6) AS span FROM m GROUP BY ALL")
def match_flags(spark, sf_dir):
    """Review flags as integers."""
    review = ((F.col("method") == "projection_fallback") & ((F.col("apl") > 60) | (F.col("share") < 0.05))).cast("int")
    return matches(spark, sf_dir).groupBy("method", review.alias("review_flag")).agg(F.count("*").alias("n"), F.round(F.sum("span"), 6).alias("span"))


@query("match_by_dir_nullkeys", f"WITH {MATCH} SELECT CASE WHEN method <> 'unmatched' THEN dir END AS dir, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY 1")
def match_by_dir_nullkeys(spark, sf_dir):
    """Unmatched rows have no direction, and their group is kept."""
    return rounded(R.shares(matches(spark, sf_dir).select(F.when(F.col("method") != "unmatched", F.col("dir")).alias("dir")), ["dir"]))


COVER = MATCH + """, hit AS (SELECT cline_id, dir, sum(span) AS span, count(*) AS n_splits FROM m WHERE method <> 'unmatched' GROUP BY ALL), usual AS (SELECT sum(span) / count(*) AS len FROM hit),
lines AS (SELECT cline_id, dir, (0.4::DOUBLE + cline_id % 11 / 8) * usual.len AS len FROM (SELECT DISTINCT l_partkey % 100 AS cline_id FROM lineitem), (VALUES ('AB'), ('BA')) AS t(dir), usual),
cov AS (SELECT cline_id, dir, len, coalesce(span, 0) AS span, coalesce(n_splits, 0) AS n_splits, coalesce(span, 0) / len AS cov FROM lines LEFT JOIN hit USING (cline_id, dir))"""


def coverage(spark, sf_dir):
    """Matched spans by directed corridor against its length; corridors without a match stay with 0.

    A corridor's length is a share, 0.4 to 1.65, of what is matched on the average.
    """
    m = matches(spark, sf_dir)
    hit = m.where("method <> 'unmatched'").groupBy("cline_id", "dir").agg(F.sum("span").alias("span"), F.count("*").alias("n_splits"))
    usual = hit.agg((F.sum("span") / F.count("*")).alias("_usual"))
    lines = m.select("cline_id").distinct().select("cline_id", F.explode(F.array(F.lit("AB"), F.lit("BA"))).alias("dir"))
    sized = lines.join(F.broadcast(usual)).select("cline_id", "dir", ((0.4 + F.col("cline_id") % 11 / 8) * F.col("_usual")).alias("len"))  # one row of means
    out = sized.join(hit, ["cline_id", "dir"], "left").fillna(0.0, ["span"]).fillna(0, ["n_splits"])
    return out.withColumn("cov", F.col("span") / F.col("len"))


@query("coverage_ratio", f"WITH {COVER} SELECT cline_id, dir, round(span, 6) AS span, n_splits, round(cov, 6) AS cov, round(100 * (span - len) / len, 6) AS diff_pct FROM cov")
def coverage_ratio(spark, sf_dir):
    return coverage(spark, sf_dir).select("cline_id", "dir", F.round("span", 6).alias("span"), "n_splits", F.round("cov", 6).alias("cov"), F.round(100 * (F.col("span") - F.col("len")) / F.col("len"), 6).alias("diff_pct"))


@query("matched_length_share", f"WITH {COVER} SELECT round(sum(least(span, len)) / sum(len), 6) AS share, round(sum(len), 6) AS total, count(*) FILTER (span > 0) AS n_matched FROM cov")
def matched_length_share(spark, sf_dir):
    return coverage(spark, sf_dir).agg(F.round(F.sum(F.least("span", "len")) / F.sum("len"), 6).alias("share"), F.round(F.sum("len"), 6).alias("total"), F.count_if(F.col("span") > 0).alias("n_matched"))


@query("coverage_buckets", f"WITH {COVER} SELECT CASE WHEN cov < 0.5 THEN '<0.5' WHEN cov < 0.8 THEN '0.5-0.8' WHEN cov < 1 THEN '0.8-1' WHEN cov <= 1.1 THEN '1-1.1' ELSE '>1.1' END AS bucket, count(*) AS n FROM cov WHERE n_splits > 0 GROUP BY 1")
def coverage_buckets(spark, sf_dir):
    """A32."""
    c = F.col("cov")
    bucket = F.when(c < 0.5, "<0.5").when(c < 0.8, "0.5-0.8").when(c < 1, "0.8-1").when(c <= 1.1, "1-1.1").otherwise(">1.1")
    return coverage(spark, sf_dir).where("n_splits > 0").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("coverage_4class", f"WITH {COVER}, p AS (SELECT cline_id, max((cov >= 0.9)::INT) FILTER (dir = 'AB') AS ab, max((cov >= 0.9)::INT) FILTER (dir = 'BA') AS ba FROM cov GROUP BY 1) SELECT CASE WHEN ab = 1 AND ba = 1 THEN 'both_AB_BA' WHEN ab = 1 THEN 'AB_only' WHEN ba = 1 THEN 'BA_only' ELSE 'none' END AS status, count(*) AS n FROM p GROUP BY 1")
def coverage_4class(spark, sf_dir):
    """A14, A31."""
    two = coverage(spark, sf_dir).withColumn("hit", (F.col("cov") >= 0.9).cast("int")).groupBy("cline_id").pivot("dir", ["AB", "BA"]).agg(F.max("hit")).fillna(0)
    a, b = F.col("AB") == 1, F.col("BA") == 1
    return two.groupBy(F.when(a & b, "both_AB_BA").when(a, "AB_only").when(b, "BA_only").otherwise("none").alias("status")).agg(F.count("*").alias("n"))


@query("n_splits_hist", f"WITH {COVER} SELECT n_splits, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cov WHERE n_splits > 0 GROUP BY 1")
def n_splits_hist(spark, sf_dir):
    return rounded(R.shares(coverage(spark, sf_dir).where("n_splits > 0").select("n_splits"), ["n_splits"]))


@query("hist_10", f"WITH {PANEL}, b AS (SELECT min(cl_speed_kmh) AS lo, max(cl_speed_kmh) AS hi FROM panel) SELECT CAST(least(floor((cl_speed_kmh - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n, round(lo + bin * ((hi - lo) / 10), 6) AS left_edge FROM panel, b GROUP BY ALL")
def hist_10(spark, sf_dir):
    return rounded(R.histogram(panel(spark, sf_dir), "cl_speed_kmh", 10))


@query("manual_override_apply", """WITH o AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS line FROM lineitem GROUP BY 1 HAVING count(*) = 1), ov AS (SELECT l_orderkey, o.line, l_orderkey % 100 AS cline_id FROM o WHERE l_orderkey % 3 = 0)
SELECT l.l_orderkey, l.l_linenumber, coalesce(ov.cline_id, l.l_partkey % 100) AS cline_id, CASE WHEN ov.cline_id IS NOT NULL THEN 'manual_override' WHEN l_returnflag = 'N' THEN 'unmatched' ELSE 'auto' END AS method FROM lineitem l LEFT JOIN ov ON l.l_orderkey = ov.l_orderkey AND l.l_linenumber = ov.line""")
def manual_override_apply(spark, sf_dir):
    """Overrides for edges with exactly one split, applied by a left join."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    single = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("l_linenumber")).where("n = 1")
    over = single.where("l_orderkey % 3 = 0").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 100).alias("manual"))
    m = F.col("manual").isNotNull()
    return li.join(over, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", F.coalesce("manual", F.col("l_partkey") % 100).alias("cline_id"), F.when(m, "manual_override").when(F.col("l_returnflag") == "N", "unmatched").otherwise("auto").alias("method"))


@query("key_alignment", "SELECT n_regionkey, count(*) AS n, count(r_regionkey) AS found, round(count(r_regionkey) / count(*), 6) AS found_share FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey GROUP BY 1")
def key_alignment(spark, sf_dir):
    """A found flag beside a left join on the natural key."""
    r = table(spark, sf_dir, "region").where("r_regionkey < 3").select("r_regionkey")
    j = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.count("r_regionkey").alias("found"), F.round(F.count("r_regionkey") / F.count("*"), 6).alias("found_share"))


@query("review_candidates", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'N' AND l_quantity >= 50 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def review_candidates(spark, sf_dir):
    """The longest unmatched rows, a top-k report."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'N' AND l_quantity >= 50").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100)


@query("unmatched_customers", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def unmatched_customers(spark, sf_dir):
    """Anti join."""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(big, c.c_custkey == big.o_custkey, "left_anti")


@query("within_group_flags", "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) > 1 AS is_split FROM lineitem")
def within_group_flags(spark, sf_dir):
    """Whether a row's group has more rows."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.count("*").over(Window.partitionBy("l_orderkey")) > 1).alias("is_split"))


@query("keep_last", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def keep_last(spark, sf_dir):
    """max_by keeps one row a key with partial aggregation, where a window would sort all of them."""
    o = table(spark, sf_dir, "orders")
    best = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r"))
    return best.select("o_custkey", "r.o_orderkey", "r.o_totalprice")


@query("length_cdf", "SELECT l_quantity, round(max(cd), 6) AS cdf, count(*) AS n FROM (SELECT l_quantity, cume_dist() OVER (ORDER BY l_quantity) AS cd FROM lineitem) GROUP BY 1")
def length_cdf(spark, sf_dir):
    """The distribution from counts by value, so that only distinct values are ranked in one place."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    upto, every = Window.orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    return n.select("l_quantity", F.round(F.sum("n").over(upto) / F.sum("n").over(every), 6).alias("cdf"), "n")


@query("cost_comparison", """WITH c AS (SELECT l_quantity AS pop, l_extendedprice / 1000 AS old, l_extendedprice / 1000 * (1 + l_discount - l_tax) AS new FROM lineitem)
SELECT round(sum(old * pop) / sum(pop), 6) AS mean_old, round(sum(new * pop) / sum(pop), 6) AS mean_new, round(sum(abs(new - old) * pop) / sum(pop), 6) AS mean_abs, round(avg((new > old)::INT), 6) AS share_slower, round(quantile_cont(new / old, 0.1), 6) AS p10, round(median(new / old), 6) AS med, round(quantile_cont(new / old, 0.9), 6) AS p90, round(corr(old, new), 6) AS r FROM c""")
def cost_comparison(spark, sf_dir):
    """The whole summary in one global aggregate."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("pop"), (F.col("l_extendedprice") / 1000).alias("old"), (F.col("l_extendedprice") / 1000 * (1 + F.col("l_discount") - F.col("l_tax"))).alias("new"))
    q, w = F.col("new") / F.col("old"), F.col("pop")
    return rounded(c.agg(weighted_mean(F.col("old"), w).alias("mean_old"), weighted_mean(F.col("new"), w).alias("mean_new"), weighted_mean(F.abs(F.col("new") - F.col("old")), w).alias("mean_abs"), F.avg((F.col("new") > F.col("old")).cast("int")).alias("share_slower"), F.percentile(q, 0.1).alias("p10"), F.median(q).alias("med"), F.percentile(q, 0.9).alias("p90"), F.corr("old", "new").alias("r")))


@query("normalize_ids", "SELECT * FROM (VALUES (1, '7'), (2, '7'), (3, '7.5'), (4, '7'), (5, '1000'), (6, NULL), (7, NULL), (8, NULL), (9, 'sq_1_2'), (10, NULL), (11, NULL)) AS t(i, id)")
def normalize_ids(spark, sf_dir):
    rows = "(1, '7'), (2, '7.0'), (3, '7.5'), (4, '007'), (5, '1e3'), (6, ' nan '), (7, '<NA>'), (8, ''), (9, 'sq_1_2'), (10, 'inf'), (11, NULL)"
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(i, raw)").select("i", grid_id(F.col("raw")).alias("id"))


@query("percent_labels", "SELECT o_orderstatus, printf('%.2f%%', count(*) * 100.0 / (SELECT count(*) FROM orders)) AS share FROM orders GROUP BY 1")
def percent_labels(spark, sf_dir):
    s = R.shares(table(spark, sf_dir, "orders"), ["o_orderstatus"])
    return s.select("o_orderstatus", percent_text(F.col("share")).alias("share"))


@query("metric_long", f"WITH {PANEL} SELECT 'speed' AS section, 'all' AS scope, unnest(['n', 'mean', 'median', 'p10', 'p90']) AS metric, unnest([count(*)::DOUBLE, round(avg(cl_speed_kmh), 6), round(median(cl_speed_kmh), 6), round(quantile_cont(cl_speed_kmh, 0.1), 6), round(quantile_cont(cl_speed_kmh, 0.9), 6)]) AS value FROM panel")
def metric_long(spark, sf_dir):
    """One aggregate turned to rows."""
    v = F.col("cl_speed_kmh")
    one = panel(spark, sf_dir).agg(F.count("*").cast("double").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, 0.1).alias("p10"), F.percentile(v, 0.9).alias("p90"))
    return one.select(F.lit("speed").alias("section"), F.lit("all").alias("scope"), F.expr("stack(5, 'n', n, 'mean', round(mean, 6), 'median', round(median, 6), 'p10', round(p10, 6), 'p90', round(p90, 6)) AS (metric, value)"))


@query("version_compare", "SELECT 'v' || n_regionkey AS version_id, count(*) AS n_nations, min(n_name) AS first_name, CASE WHEN n_regionkey < 2 THEN max(n_nationkey) END AS extra FROM nation GROUP BY n_regionkey")
def version_compare(spark, sf_dir):
    """Versions whose metrics differ in columns, side by side."""
    n = table(spark, sf_dir, "nation")
    base = lambda d: d.groupBy(F.concat(F.lit("v"), "n_regionkey").alias("version_id"))
    old = base(n.where("n_regionkey >= 2")).agg(F.count("*").alias("n_nations"), F.min("n_name").alias("first_name"))
    new = base(n.where("n_regionkey < 2")).agg(F.count("*").alias("n_nations"), F.min("n_name").alias("first_name"), F.max("n_nationkey").alias("extra"))
    return new.unionByName(old, allowMissingColumns=True)


@query("panel_table", f"WITH {OBS} SELECT dir, weekday_label, count(*) AS n, round(avg(speed), 6) AS mean, round(stddev_samp(speed), 6) AS sd, round(median(speed), 6) AS median FROM ok GROUP BY ALL")
def panel_table(spark, sf_dir):
    """A22, M28."""
    return rounded(observations(spark, sf_dir).where("matched = 1 AND speed > 0 AND seg_len_m > 0").groupBy("dir", "weekday_label").agg(F.count("*").alias("n"), F.avg("speed").alias("mean"), F.stddev_samp("speed").alias("sd"), F.median("speed").alias("median")))


@query("pair_direction_census", f"WITH {EDGES}, p AS (SELECT least(grid_o, grid_d) AS a, greatest(grid_o, grid_d) AS b, bool_or(grid_o < grid_d) AS up, bool_or(grid_o > grid_d) AS down FROM edges GROUP BY ALL) SELECT count(*) AS total, count(*) FILTER (up AND down) AS two_way, count(*) FILTER (up <> down) AS one_way FROM p")
def pair_direction_census(spark, sf_dir):
    """A42."""
    o, d = F.col("grid_o"), F.col("grid_d")
    p = grid_edges(spark, sf_dir).groupBy(F.least(o, d).alias("a"), F.greatest(o, d).alias("b")).agg(F.bool_or(o < d).alias("up"), F.bool_or(o > d).alias("down"))
    return p.agg(F.count("*").alias("total"), F.count_if(F.col("up") & F.col("down")).alias("two_way"), F.count_if(F.col("up") != F.col("down")).alias("one_way"))


@query("sym_edges", f"WITH {EDGES}, p AS (SELECT grid_o, grid_d, min(t_min) AS t FROM edges GROUP BY ALL) SELECT least(grid_o, grid_d) AS a, greatest(grid_o, grid_d) AS b, round(avg(t), 6) AS t FROM p GROUP BY ALL")
def sym_edges(spark, sf_dir):
    """A46."""
    p = grid_edges(spark, sf_dir).groupBy("grid_o", "grid_d").agg(F.min("t_min").alias("t"))
    return p.groupBy(F.least("grid_o", "grid_d").alias("a"), F.greatest("grid_o", "grid_d").alias("b")).agg(F.round(F.avg("t"), 6).alias("t"))


@query("symmetric_times", f"WITH {EDGES} SELECT e.grid_o, e.grid_d, round((e.t_min + coalesce(r.t_min, e.t_min)) / 2, 6) AS t_sym, symmetric_ratio AS ratio FROM (SELECT e.*, r.t_min AS back, least(e.t_min / r.t_min, r.t_min / e.t_min) AS symmetric_ratio FROM edges e LEFT JOIN edges r ON e.grid_o = r.grid_d AND e.grid_d = r.grid_o) e LEFT JOIN edges r ON e.grid_o = r.grid_d AND e.grid_d = r.grid_o")
def symmetric_times(spark, sf_dir):
    """Each edge with its reverse; one-way edges keep their time."""
    e = grid_edges(spark, sf_dir)
    back = e.select(F.col("grid_d").alias("grid_o"), F.col("grid_o").alias("grid_d"), F.col("t_min").alias("back"))
    return e.join(back, ["grid_o", "grid_d"], "left").select("grid_o", "grid_d", F.round((F.col("t_min") + F.coalesce("back", "t_min")) / 2, 6).alias("t_sym"), symmetric_ratio(F.col("t_min"), F.col("back")).alias("ratio"))


@query("mean_degree", f"WITH {EDGES}, u AS (SELECT DISTINCT least(grid_o, grid_d) AS a, greatest(grid_o, grid_d) AS b FROM edges), d AS (SELECT n, count(*) AS deg FROM (SELECT a AS n FROM u UNION ALL SELECT b FROM u) GROUP BY n) SELECT round(avg(deg), 6) AS mean_degree, count(*) AS nodes, max(deg) AS max_degree FROM d")
def mean_degree(spark, sf_dir):
    """A25, A33."""
    u = grid_edges(spark, sf_dir).select(F.least("grid_o", "grid_d").alias("a"), F.greatest("grid_o", "grid_d").alias("b")).distinct()
    deg = u.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("deg"))
    return deg.agg(F.round(F.avg("deg"), 6).alias("mean_degree"), F.count("*").alias("nodes"), F.max("deg").alias("max_degree"))
