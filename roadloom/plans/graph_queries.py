"""Graph, ordered, model and figure-data queries on the proxies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadloom.operators import equilibrium as E
from roadloom.operators import graph as G
from roadloom.operators import model as M
from roadloom.operators import relational as R
from roadloom.operators import spatial as S
from roadloom.plans import query
from roadloom.plans.geometry_queries import VERT, lines
from roadloom.plans.od_queries import EDGES, OD, grid_edges, od_matrix
from roadloom.plans.panel_queries import ASYM, PANEL, asymmetry, panel, rounded
from roadloom.sources.store import stored
from roadloom.sources.tables import table

UND = EDGES + ", und AS (SELECT grid_o AS a, grid_d AS b FROM edges UNION SELECT grid_d, grid_o FROM edges)"
REACH = UND.replace("edges AS", "edges AS", 1) + ", reach AS (SELECT DISTINCT a AS n, a AS m FROM und UNION SELECT n, b FROM reach JOIN und ON m = a), comp AS (SELECT n AS node, min(m) AS component FROM reach GROUP BY 1)"
PATHS = EDGES + ", hop AS (SELECT grid_o AS o, grid_d AS d, t_min AS t, 1 AS k FROM edges UNION ALL SELECT o, d, min(t) AS t, k FROM (SELECT o, e.grid_d AS d, hop.t + e.t_min AS t, k + 1 AS k FROM hop JOIN edges e ON hop.d = e.grid_o WHERE k < 10 AND o <> e.grid_d) GROUP BY o, d, k), best AS (SELECT o, d, min(t) AS t FROM hop GROUP BY ALL)"


@query("components", f"WITH RECURSIVE {REACH} SELECT node, component FROM comp")
def components(spark, sf_dir):
    """By least label and pointer jumping."""
    return G.components(grid_edges(spark, sf_dir), "grid_o", "grid_d")


@query("component_sizes", f"WITH RECURSIVE {REACH} SELECT component, count(*) AS n FROM comp GROUP BY 1")
def component_sizes(spark, sf_dir):
    return components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n"))


@query("od_reachable", f"WITH RECURSIVE {REACH}, {OD} SELECT home_grid, work_grid, pop FROM od JOIN comp a ON home_grid = a.node JOIN comp b ON work_grid = b.node WHERE a.component = b.component")
def od_reachable(spark, sf_dir):
    """Flows between cells of one weak component."""
    c, o = components(spark, sf_dir), od_matrix(spark, sf_dir).select("home_grid", "work_grid", "pop")
    home = c.select(F.col("node").alias("home_grid"), F.col("component").alias("_h"))
    work = c.select(F.col("node").alias("work_grid"), F.col("component").alias("_w"))
    return o.join(home, "home_grid").join(work, "work_grid").where("_h = _w").select(F.col("home_grid").cast("int").alias("home_grid"), F.col("work_grid").cast("int").alias("work_grid"), "pop")


@query("network_summary", f"WITH RECURSIVE {REACH}, {OD}, j AS (SELECT pop, a.component = b.component AS ok FROM od JOIN comp a ON home_grid = a.node JOIN comp b ON work_grid = b.node) SELECT count(*) AS n_pairs, count(*) FILTER (ok) AS n_reachable, round(count(*) FILTER (ok) / count(*), 6) AS pair_share, round(sum(pop) FILTER (ok) / sum(pop), 6) AS pop_share FROM j")
def network_summary(spark, sf_dir):
    o, r = od_matrix(spark, sf_dir).select("home_grid", "work_grid", "pop"), od_reachable(spark, sf_dir).select("home_grid", "work_grid", F.lit(True).alias("ok"))
    j = o.join(r, ["home_grid", "work_grid"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return j.agg(F.count("*").alias("n_pairs"), F.count_if("ok").alias("n_reachable"), F.round(F.count_if("ok") / F.count("*"), 6).alias("pair_share"), F.round(F.sum(F.when(F.col("ok"), F.col("pop"))) / F.sum("pop"), 6).alias("pop_share"))


@query("degree_histogram", f"WITH {EDGES}, d AS (SELECT n, count(*) AS degree FROM (SELECT grid_o AS n FROM edges UNION ALL SELECT grid_d FROM edges) GROUP BY 1) SELECT degree, count(*) AS n FROM d GROUP BY 1")
def degree_histogram(spark, sf_dir):
    return G.degrees(grid_edges(spark, sf_dir), "grid_o", "grid_d").groupBy("degree").agg(F.count("*").alias("n"))


@query("fastest_edges", "WITH e AS (SELECT l_suppkey % 20 AS u, l_partkey % 20 AS v, l_extendedprice / 100000 AS t FROM lineitem) SELECT u, v, round(min(t), 8) AS t FROM e WHERE u <> v AND t >= 0.02 GROUP BY ALL")
def fastest_edges(spark, sf_dir):
    """R11."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("u"), (F.col("l_partkey") % 20).alias("v"), (F.col("l_extendedprice") / 100000).alias("t"))
    return rounded(G.fastest_edges(e, "u", "v", "t"), 8)


def paths(spark, sf_dir):
    return G.shortest_paths(grid_edges(spark, sf_dir), "grid_o", "grid_d", "t_min")


@query("shortest_paths", f"WITH RECURSIVE {PATHS} SELECT o AS grid_o, d AS grid_d, round(t, 6) AS t_min FROM best WHERE o <> d")
def shortest_paths(spark, sf_dir):
    """Directed, by doubling."""
    return rounded(paths(spark, sf_dir))


@query("od_costs", f"WITH RECURSIVE {PATHS}, {OD}, h AS (SELECT median(t_min) / 2 AS c FROM edges) SELECT home_grid, work_grid, round(CASE WHEN home_grid = work_grid THEN c ELSE t END, 6) AS cost, pop FROM od LEFT JOIN best ON o = home_grid AND d = work_grid AND o <> d, h")
def od_costs(spark, sf_dir):
    """Path cost of each flow, half the median edge within a cell, null where no path leads."""
    e, o = grid_edges(spark, sf_dir), od_matrix(spark, sf_dir).select(F.col("home_grid").cast("int").alias("home_grid"), F.col("work_grid").cast("int").alias("work_grid"), "pop")
    p = paths(spark, sf_dir)
    j = o.join(p, (o.home_grid == p.grid_o) & (o.work_grid == p.grid_d), "left")
    return j.select("home_grid", "work_grid", F.round(F.when(F.col("home_grid") == F.col("work_grid"), G.half_median(e, "t_min")).otherwise(F.col("t_min")), 6).alias("cost"), "pop")


FLOWS = PATHS + """, pr AS (SELECT o, d, t FROM best WHERE o <> d), nxt AS (SELECT e.grid_o AS i, p.d AS dest, min(e.grid_d) AS j FROM edges e JOIN pr p ON p.o = e.grid_o LEFT JOIN pr r ON r.o = e.grid_d AND r.d = p.d WHERE abs(e.t_min + CASE WHEN e.grid_d = p.d THEN 0 ELSE r.t END - p.t) < 1e-9 GROUP BY ALL),
walk AS (SELECT home_grid AS i, work_grid AS dest, pop AS v, 0 AS k FROM od WHERE home_grid <> work_grid UNION ALL SELECT j, w.dest, w.v, w.k + 1 FROM walk w JOIN nxt ON nxt.i = w.i AND nxt.dest = w.dest WHERE w.k < 12 AND w.i <> w.dest)"""


@query("path_flows", f"WITH RECURSIVE {OD}, {FLOWS} SELECT w.i, n.j, round(sum(v), 4) AS flow FROM walk w JOIN nxt n ON n.i = w.i AND n.dest = w.dest GROUP BY ALL")
def path_flows(spark, sf_dir):
    """R08."""
    e, o = grid_edges(spark, sf_dir), od_matrix(spark, sf_dir).select(F.col("home_grid").cast("long").alias("home"), F.col("work_grid").cast("long").alias("work"), "pop")
    f = G.path_flows(e, paths(spark, sf_dir), o, "grid_o", "grid_d", "t_min")
    return f.select(F.col("i").cast("int").alias("i"), "j", F.round("flow", 4).alias("flow"))


THETA, ROUNDS = 2.0, 3


def z_sql(rounds: int) -> str:
    out = f"{EDGES}, w AS (SELECT grid_o AS i, grid_d AS m, pow(greatest(t_min, 1.001), -{THETA}) AS w FROM edges), dst AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS dest FROM supplier), z0 AS (SELECT dest, dest AS i, 1.0::DOUBLE AS z FROM dst)"
    for k in range(rounds):
        out += f", z{k + 1} AS (SELECT dest, w.i, sum(w * z) AS z FROM w JOIN z{k} ON z{k}.i = w.m WHERE w.i <> dest GROUP BY ALL UNION ALL SELECT dest, dest, 1.0 FROM dst)"
    return out


def destinations(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("dest")).distinct()


@query("soft_tau_k", f"WITH {z_sql(ROUNDS)} SELECT dest, i, round(pow(z, -1 / {THETA}), 6) AS tau FROM z{ROUNDS} WHERE z > 1e-12 AND i <> dest")
def soft_tau_k(spark, sf_dir):
    """R09 after three rounds: expected time under soft route choice."""
    z = G.soft_values(grid_edges(spark, sf_dir), destinations(spark, sf_dir), THETA, ROUNDS)
    return z.where("z > 1e-12 AND i <> dest").select("dest", "i", F.round(F.pow("z", F.lit(-1 / THETA)), 6).alias("tau"))


def soft_sql(rounds: int) -> str:
    out = f"{z_sql(rounds)}, {OD}, p AS (SELECT a.dest, w.i, w.m AS j, least(1.0, w * b.z / a.z) AS p FROM w JOIN z{rounds} a ON a.i = w.i JOIN z{rounds} b ON b.i = w.m AND b.dest = a.dest WHERE a.z > 1e-12 AND w.i <> a.dest), v0 AS (SELECT work_grid AS dest, home_grid AS i, sum(pop) AS v FROM od WHERE home_grid <> work_grid GROUP BY ALL)"
    for k in range(rounds):
        out += f", v{k + 1} AS (SELECT dest, i, sum(v) AS v FROM (SELECT * FROM v0 UNION ALL SELECT p.dest, p.j, v * p FROM p JOIN v{k} x ON x.dest = p.dest AND x.i = p.i) GROUP BY ALL)"
    return out


@query("soft_flow_k", f"WITH {soft_sql(ROUNDS)} SELECT p.i, p.j, round(sum(v * p), 4) AS flow FROM p JOIN v{ROUNDS} x ON x.dest = p.dest AND x.i = p.i GROUP BY ALL")
def soft_flow_k(spark, sf_dir):
    e = grid_edges(spark, sf_dir)
    o = od_matrix(spark, sf_dir).select(F.col("home_grid").cast("long").alias("home"), F.col("work_grid").cast("long").alias("work"), "pop")
    z = stored(G.soft_values(e, destinations(spark, sf_dir), THETA, ROUNDS))
    return rounded(G.soft_flows(e, z, o, THETA, ROUNDS), 4)


GRAVITY = f"WITH {OD}, g AS (SELECT home_grid AS o, work_grid AS d, ln(1 + (3 * home_grid + 5 * work_grid) % 7) AS x, ln(pop) AS y FROM od)"


def demean_sql(rounds: int) -> str:
    out, last = GRAVITY, "g"
    for k in range(rounds):
        out += f", a{k} AS (SELECT o, d, x - avg(x) OVER (PARTITION BY o) AS x, y - avg(y) OVER (PARTITION BY o) AS y FROM {last}), b{k} AS (SELECT o, d, x - avg(x) OVER (PARTITION BY d) AS x, y - avg(y) OVER (PARTITION BY d) AS y FROM a{k})"
        last = f"b{k}"
    return f"{out} SELECT round(sum(x * y) / sum(x * x), 6) AS beta, round(greatest(0.1, -sum(x * y) / sum(x * x)), 6) AS theta FROM {last}"


@query("theta_two_way_fe_k", demean_sql(4))
def theta_two_way_fe_k(spark, sf_dir):
    """M18 after four rounds."""
    o = od_matrix(spark, sf_dir).select(F.col("home_grid").alias("o"), F.col("work_grid").alias("d"), "pop", (1 + (3 * F.col("home_grid") + 5 * F.col("work_grid")) % 7).cast("double").alias("tau"))
    return rounded(M.theta_two_way(o, 4))


LAMBDA = "e AS (SELECT 1 + l_partkey % 4 + l_discount AS lane, l_quantity * 3 AS flow, 1 + l_extendedprice / 100000 AS t_ff, (1 + l_extendedprice / 100000) * pow(l_quantity, 0.2) AS t_obs FROM lineitem)"


@query("lambda_lane_bin_fe", f"WITH {LAMBDA}, l AS (SELECT greatest(1.0, round_even(lane, 0)) AS bin, ln(flow / greatest(lane, 0.5)) AS x, ln(t_obs / t_ff) AS y FROM e), c AS (SELECT x - avg(x) OVER (PARTITION BY bin) AS x, y - avg(y) OVER (PARTITION BY bin) AS y FROM l) SELECT round(greatest(0.01, least(1.5, sum(x * y) / sum(x * x))), 6) AS \"lambda\" FROM c")
def lambda_lane_bin_fe(spark, sf_dir):
    """M19."""
    li = table(spark, sf_dir, "lineitem")
    ff = 1 + F.col("l_extendedprice") / 100000
    e = li.select((1 + F.col("l_partkey") % 4 + F.col("l_discount")).alias("lane"), (F.col("l_quantity") * 3).alias("flow"), ff.alias("t_ff"), (ff * F.pow("l_quantity", F.lit(0.2))).alias("t_obs"))
    return rounded(M.lambda_by_lane(e))


def tau(o, d):
    return 1 + (3 * o + 5 * d) % 7


COSTS = "n AS (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation), costs AS (SELECT a.node AS o, b.node AS d, (1 + (3 * a.node + 5 * b.node) % 7)::DOUBLE AS tau FROM n a, n b), nodes AS (SELECT node, (1 + node) / 325.0::DOUBLE AS residents, (26 - node - 1 + 0.0)::DOUBLE / 325.0 AS jobs FROM n)"


def nodes_and_costs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    a, b = n.select(F.col("node").alias("o")), n.select(F.col("node").alias("d"))
    costs = a.join(b, F.lit(True)).select("o", "d", tau(F.col("o"), F.col("d")).cast("double").alias("tau"))  # J23: the cells' pairs, 625
    return n.select("node", ((1 + F.col("node")) / F.lit(325.0)).alias("residents"), ((25 - F.col("node")) / F.lit(325.0)).alias("jobs")), costs


def invert_sql(theta: float, rounds: int) -> str:
    out = f"WITH {COSTS}, k AS (SELECT o, d, pow(tau, -{theta}) AS k FROM costs), s0 AS (SELECT node, residents, jobs, 1.0::DOUBLE AS u, 1.0::DOUBLE AS a FROM nodes)"
    for i in range(rounds):
        out += f", u{i} AS (SELECT s.node, residents, jobs, residents / m AS u, a FROM s{i} s JOIN (SELECT o, sum(k * a) AS m FROM k JOIN s{i} ON node = d GROUP BY 1) ON o = s.node), un{i} AS (SELECT node, residents, jobs, u / exp(avg(ln(u)) OVER ()) AS u, a FROM u{i})"
        out += f", a{i} AS (SELECT s.node, residents, jobs, u, jobs / m AS a FROM un{i} s JOIN (SELECT d, sum(k * u) AS m FROM k JOIN un{i} ON node = o GROUP BY 1) ON d = s.node), s{i + 1} AS (SELECT node, residents, jobs, u, a / exp(avg(ln(a)) OVER ()) AS a FROM a{i})"
    return f"{out} SELECT node, round(u, 6) AS u, round(a, 6) AS a FROM s{rounds}"


@query("invert_k", invert_sql(1.5, 3))
def invert_k(spark, sf_dir):
    """M20 after three rounds."""
    nodes, costs = nodes_and_costs(spark, sf_dir)
    return M.inverted(nodes, costs, 1.5, 3).select("node", F.round("u", 6).alias("u"), F.round("a", 6).alias("a"))


def population_sql(theta: float, rounds: int) -> str:
    out = f"WITH {COSTS}, k AS (SELECT o, d, pow(tau, -{theta}) AS k FROM costs), s0 AS (SELECT node, 1.0::DOUBLE AS u, 1.0::DOUBLE AS a, residents, jobs FROM nodes)"
    for i in range(rounds):
        out += f", m{i} AS (SELECT o, d, k * l.u * pow(l.residents, {theta} * -0.10) * (r.a * pow(r.jobs, {theta} * -0.12)) AS m FROM k JOIN s{i} l ON l.node = o JOIN s{i} r ON r.node = d), h{i} AS (SELECT o, d, m / sum(m) OVER () AS share FROM m{i})"
        out += f", t{i} AS (SELECT node, u, a, 0.5 * residents + 0.5 * (SELECT sum(share) FROM h{i} WHERE o = node) AS residents, 0.5 * jobs + 0.5 * (SELECT sum(share) FROM h{i} WHERE d = node) AS jobs FROM s{i}), s{i + 1} AS (SELECT node, u, a, residents / sum(residents) OVER () AS residents, jobs / sum(jobs) OVER () AS jobs FROM t{i})"
    return f"{out} SELECT o, d, round(share, 8) AS share FROM h{rounds - 1}"


@query("population_k", population_sql(1.5, 3))
def population_k(spark, sf_dir):
    """M21 after three rounds."""
    nodes, costs = nodes_and_costs(spark, sf_dir)
    start = nodes.select("node", F.lit(1.0).alias("u"), F.lit(1.0).alias("a"), "residents", "jobs")
    return M.population(start, costs, 1.5, 3).select("o", "d", F.round("share", 8).alias("share"))


FLOWED = EDGES + ", fe AS (SELECT grid_o, grid_d, t_min, t_min * 0.8 AS t_ff, 100.0 + (7 * grid_o + 11 * grid_d) % 50 AS flow, 1.0::DOUBLE + (grid_o + grid_d) % 3 AS lane FROM edges)"


def flowed(spark, sf_dir):
    o, d = F.col("grid_o"), F.col("grid_d")
    return grid_edges(spark, sf_dir).select("grid_o", "grid_d", "t_min", (F.col("t_min") * 0.8).alias("t_ff"), (100.0 + (7 * o + 11 * d) % 50).alias("flow"), (1.0 + (o + d) % 3).alias("lane"))


@query("congestion_update", f"WITH {FLOWED} SELECT grid_o, grid_d, round(0.65 * t_min + 0.35 * t_ff * pow(flow / greatest(lane, 0.25), 0.15), 6) AS t_new FROM fe")
def congestion_update(spark, sf_dir):
    return M.congested_times(flowed(spark, sf_dir), 0.15).select("grid_o", "grid_d", F.round("t_new", 6).alias("t_new"))


@query("top_congested", f"WITH {FLOWED} SELECT grid_o, grid_d, round(flow * t_min / greatest(lane, 0.5), 6) AS score FROM fe ORDER BY flow * t_min / greatest(lane, 0.5) DESC, grid_o, grid_d LIMIT 5")
def top_congested(spark, sf_dir):
    """A top-k report."""
    return M.top_congested(flowed(spark, sf_dir), 5).select("grid_o", "grid_d", F.round("score", 6).alias("score"))


@query("lane_reallocate", f"WITH {FLOWED}, top AS (SELECT grid_o, grid_d FROM fe ORDER BY flow * t_min / greatest(lane, 0.5) DESC, grid_o, grid_d LIMIT 5) SELECT e.grid_o, e.grid_d, CASE WHEN r.grid_o IS NOT NULL THEN greatest(0.25, e.lane + CASE WHEN t.grid_o IS NOT NULL THEN 1 ELSE 0 END - 1) ELSE e.lane + CASE WHEN t.grid_o IS NOT NULL THEN 1 ELSE 0 END END AS lane FROM fe e LEFT JOIN top t ON t.grid_o = e.grid_o AND t.grid_d = e.grid_d LEFT JOIN top r ON r.grid_d = e.grid_o AND r.grid_o = e.grid_d")
def lane_reallocate(spark, sf_dir):
    """M23."""
    e = flowed(spark, sf_dir)
    return M.reallocated(e, M.top_congested(e, 5)).select("grid_o", "grid_d", "lane")


@query("equilibrium_summary", f"WITH {FLOWED} SELECT round(avg(t_min), 6) AS avg_edge_time, round(sum(t_min * flow) / sum(flow), 6) AS flow_weighted_time, CAST(round(sum(flow), 6) AS DOUBLE) AS total_flow, max(t_min) AS max_time FROM fe")
def equilibrium_summary(spark, sf_dir):
    return rounded(M.equilibrium_summary(flowed(spark, sf_dir)))


MODEL = E.Parameters(theta=THETA)


def commutes(spark, sf_dir):
    return od_matrix(spark, sf_dir).select(F.col("home_grid").cast("long").alias("home"), F.col("work_grid").cast("long").alias("work"), (F.col("pop") / 1000).alias("pop"))


@query("congested_equilibrium")
def congested_equilibrium(spark, sf_dir):
    """Routes, places and times of travel to a tolerance of 1e-6."""
    one = flowed(spark, sf_dir).select(F.lit("observed").alias("scenario"), F.lit(MODEL.lam).alias("lambda"), "grid_o", "grid_d", "t_min", "t_ff", "lane")
    return E.solved(one, commutes(spark, sf_dir), MODEL)


@query("counterfactual_suite")
def counterfactual_suite(spark, sf_dir):
    """Each lambda, rule and number of treated edges solved anew, against the same lambda's baseline."""
    e, out = flowed(spark, sf_dir), None
    rules = {"congestion": F.col("flow") * F.col("t_min") / F.greatest("lane", F.lit(0.5)), "tidal": F.abs(F.col("grid_o") - F.col("grid_d")) * F.col("flow")}
    for rule, n in [("baseline", 0), *[(r, n) for r in rules for n in (5, 10)]]:
        lanes = M.reallocated(e, E.top_edges(e, rules[rule], n)) if n else e
        for lam in (0.05, 0.15):
            label = f"baseline_lambda_{lam:.2f}" if not n else f"{rule}_top_{n}_lambda_{lam:.2f}"
            one = lanes.select(F.lit(label).alias("scenario"), F.lit(lam).alias("lambda"), "grid_o", "grid_d", "t_min", "t_ff", "lane")
            out = one if out is None else out.unionByName(one)
    result = E.solved(out, commutes(spark, sf_dir), MODEL).groupBy("scenario").agg(*[F.first(c).alias(c) for c in ("welfare", "avg_edge_time", "weighted_commute", "n_iter", "converged")])
    lam = F.regexp_extract("scenario", r"lambda_(\d+\.\d+)", 1).try_cast("double")
    return E.against_baseline(result.withColumn("lambda", lam), "baseline", ["welfare", "weighted_commute"])


@query("scenario_labels", "SELECT * FROM (VALUES ('lambda_0.05_congestion_top_5', 0.05::DOUBLE, 'congestion', 5), ('lambda_0.15_reversal_top_10', 0.15, 'reversal', 10), ('baseline', NULL, NULL, NULL)) AS t(label, \"lambda\", family, top_n)")
def scenario_labels(spark, sf_dir):
    """P20."""
    d = spark.sql("SELECT * FROM VALUES ('lambda_0.05_congestion_top_5'), ('lambda_0.15_reversal_top_10'), ('baseline') AS t(label)")
    got = lambda p, g=1: F.nullif(F.regexp_extract("label", p, g), F.lit(""))
    return d.select("label", got(r"lambda_(\d+\.\d+)").try_cast("double").alias("lambda"), got(r"_([a-z]+)_top_").alias("family"), got(r"top_(\d+)").try_cast("int").alias("top_n"))


@query("pct_change_scenarios", "SELECT o_orderpriority AS scenario, round(t, 6) AS total, round(t / lag(t) OVER (ORDER BY o_orderpriority) - 1, 6) AS change, round(t / first_value(t) OVER (ORDER BY o_orderpriority) - 1, 6) AS to_first FROM (SELECT o_orderpriority, avg(o_totalprice) AS t FROM orders GROUP BY 1)")
def pct_change_scenarios(spark, sf_dir):
    """Over a few scenario rows."""
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scenario")).agg(F.avg("o_totalprice").alias("total"))
    w = Window.orderBy("scenario")
    return rounded(t.select("scenario", "total", (F.col("total") / F.lag("total").over(w) - 1).alias("change"), (F.col("total") / F.first_value("total").over(w) - 1).alias("to_first")))


CELLS = "cells AS (SELECT user_id, event_id, ts, CAST(floor(value / 100) AS BIGINT) AS cell, value FROM events)"


def cells(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") / 100).alias("cell"), "value")


RUNS = CELLS + ", f AS (SELECT *, CASE WHEN cell <> lag(cell) OVER w THEN 1 ELSE 0 END AS new FROM cells WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f), runs AS (SELECT user_id, CAST(run AS BIGINT) AS run, cell, sum(value) AS len FROM r GROUP BY ALL)"


@query("run_length_cells", f"WITH {RUNS} SELECT user_id, run, cell, round(len, 4) AS len FROM runs")
def run_length_cells(spark, sf_dir):
    """The cells that a traveller passes, equal neighbours as one."""
    c = cells(spark, sf_dir).withColumnRenamed("value", "len")
    return R.run_lengths(c, ["user_id"], ["ts", "event_id"], "cell", "len").select("user_id", "run", "cell", F.round("len", 4).alias("len"))


@query("consecutive_links", f"WITH {RUNS}, l AS (SELECT user_id, cell AS grid_o, lead(cell) OVER (PARTITION BY user_id ORDER BY run) AS grid_d, len FROM runs) SELECT grid_o, grid_d, count(*) AS n, round(sum(len), 3) AS len FROM l WHERE grid_d IS NOT NULL GROUP BY ALL")
def consecutive_links(spark, sf_dir):
    """W06, R17."""
    runs = R.run_lengths(cells(spark, sf_dir).withColumnRenamed("value", "len"), ["user_id"], ["ts", "event_id"], "cell", "len")
    return R.consecutive(runs, ["user_id"], ["run"], "cell", "len").groupBy("grid_o", "grid_d").agg(F.count("*").alias("n"), F.round(F.sum("len"), 3).alias("len"))


@query("change_points", "WITH c AS (SELECT user_id, event_id, value, CASE WHEN event_id % 3 > 0 THEN CAST(floor(value / 250) AS BIGINT) END AS cid FROM events), k AS (SELECT *, lag(cid) OVER w AS pc, lag(event_id) OVER w AS pe FROM c WHERE cid IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, (event_id + pe) / 2.0::DOUBLE AS cut, pc AS before, cid AS after FROM k WHERE pc <> cid")
def change_points(spark, sf_dir):
    """Samples without a value are passed over."""
    c = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 > 0, F.floor(F.col("value") / 250)).alias("cid"))
    return R.change_points(c, ["user_id"], "event_id", "cid")


@query("cut_merge_islands", "WITH c AS (SELECT user_id, value AS s FROM events WHERE value > 1 AND value < 399), g AS (SELECT *, CASE WHEN s - lag(s) OVER w > 3 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY user_id ORDER BY s)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT user_id, CAST(island AS BIGINT) AS island, round(avg(s), 6) AS s, count(*) AS n FROM i GROUP BY ALL")
def cut_merge_islands(spark, sf_dir):
    """Cuts of a line of 400."""
    c = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("s"), F.lit(400.0).alias("len"))
    return R.merged_cuts(c, "user_id", "s", "len", 3.0).select("user_id", "island", F.round("s", 6).alias("s"), "n")


LINKS = CELLS + """, li AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'AM' ELSE 'PM' END AS period, l_suppkey % 10 AS grid_o, l_partkey % 10 AS grid_d, l_quantity * 10 AS len_m, (1 + l_extendedprice / 1000) AS v, CASE WHEN l_discount > 0.02 THEN 1.2 * (1 + l_extendedprice / 1000) END AS v_ff0 FROM lineitem),
ln AS (SELECT *, coalesce(v_ff0, v) AS v_ff, len_m / v AS tt FROM li WHERE grid_o <> grid_d)"""


@query("grid_links_agg", f"WITH {LINKS} SELECT period, grid_o, grid_d, count(*) AS n, round(sum(len_m), 4) AS len_m, round(sum(tt), 6) AS total_tt, round(avg(tt), 6) AS mean_tt, round(sum(tt * len_m) / sum(len_m), 6) AS lenw_tt, round(sum(v * len_m) / sum(len_m), 6) AS v_len_w, round(sum(len_m) / sum(len_m / v), 6) AS v_harm, round(sum(len_m) / sum(len_m / v_ff), 6) AS v_ff_harm FROM ln GROUP BY ALL")
def grid_links_agg(spark, sf_dir):
    """All definitions of a link's time and speed from one shuffle."""
    li = table(spark, sf_dir, "lineitem")
    v = 1 + F.col("l_extendedprice") / 1000
    ln = li.select(F.when(F.col("l_orderkey") % 2 == 0, "AM").otherwise("PM").alias("period"), (F.col("l_suppkey") % 10).alias("grid_o"), (F.col("l_partkey") % 10).alias("grid_d"), (F.col("l_quantity") * 10).alias("len_m"), v.alias("v"), F.coalesce(F.when(F.col("l_discount") > 0.02, 1.2 * v), v).alias("v_ff")).where("grid_o <> grid_d")
    w, t = F.col("len_m"), F.col("len_m") / F.col("v")
    out = ln.groupBy("period", "grid_o", "grid_d").agg(F.count("*").alias("n"), F.round(F.sum(w), 4).alias("len_m"), F.sum(t).alias("total_tt"), F.avg(t).alias("mean_tt"), (F.sum(t * w) / F.sum(w)).alias("lenw_tt"), (F.sum(F.col("v") * w) / F.sum(w)).alias("v_len_w"), (F.sum(w) / F.sum(t)).alias("v_harm"), (F.sum(w) / F.sum(w / F.col("v_ff"))).alias("v_ff_harm"))
    return rounded(out)


@query("top_reversal_edges", f"WITH {PANEL}, e AS (SELECT cline_id % 25 AS grid_o, hour_of_day AS grid_d, sum(total_dist_m * (1 - least(1, greatest(0, cl_speed_kmh / 100)))) AS score FROM panel GROUP BY ALL) SELECT grid_o, grid_d, round(score, 3) AS score FROM e ORDER BY round(score, 3) DESC, grid_o, grid_d LIMIT 10")
def top_reversal_edges(spark, sf_dir):
    """A top-k report of edges by asymmetry-weighted length."""
    s = F.sum(F.col("total_dist_m") * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cl_speed_kmh") / 100))))
    e = panel(spark, sf_dir).groupBy((F.col("cline_id") % 25).alias("grid_o"), F.col("hour_of_day").alias("grid_d")).agg(F.round(s, 3).alias("score"))
    return e.orderBy(F.desc("score"), "grid_o", "grid_d").limit(10)


@query("eps_clusters", f"WITH RECURSIVE {VERT}, p AS (SELECT vec_id, x, y FROM v WHERE k = 0), near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 15), reach AS (SELECT vec_id AS n, vec_id AS m FROM p UNION SELECT n, b FROM reach JOIN near ON m = a), c AS (SELECT n, min(m) AS component FROM reach GROUP BY 1) SELECT component, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM c JOIN p ON n = vec_id GROUP BY 1")
def eps_clusters(spark, sf_dir):
    """Single-linkage clusters of first vertices at most 15 apart, and their centres."""
    p = lines(spark, sf_dir).select("vec_id", F.get("geom", F.lit(0)).alias("p")).select("vec_id", "p.x", "p.y")
    near = S.within_distance(p, p.withColumnRenamed("vec_id", "other"), "vec_id", "other", 15.0).where("vec_id < other")
    c = G.components(near, "vec_id", "other", p.select(F.col("vec_id").alias("node")))
    return c.join(p, c.node == p.vec_id).groupBy("component").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query("voronoi_assign")
def voronoi_assign(spark, sf_dir):
    """TS3: cells of greedy seeds; points join their nearest seed through tiles."""
    p = lines(spark, sf_dir).select("vec_id", F.get("geom", F.lit(0)).alias("p")).select("vec_id", "p.x", "p.y")
    seeds = stored(S.poisson_seeds(p, "vec_id", 60.0).select(F.col("vec_id").alias("seed"), "x", "y"))
    near = S.nearest(S.within_distance(p, seeds, "vec_id", "seed", 60.0), "vec_id", "seed", 1)
    return near.select("vec_id", "seed", "dist")


@query("reversal_overlay", f"WITH {ASYM} SELECT DISTINCT cline_id, peak, faster_dir AS dir FROM asym WHERE ratio < 0.8")
def reversal_overlay(spark, sf_dir):
    """long form of the directions that an asymmetric corridor's peaks favour."""
    a = asymmetry(spark, sf_dir).where("ratio < 0.8")
    return a.select("cline_id", "peak", F.col("faster_dir").alias("dir")).distinct()
