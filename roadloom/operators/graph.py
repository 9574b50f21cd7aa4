"""Graph operators as iterated joins; each round is written, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.sources.store import stored


def components(edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None, node: str = "node") -> DataFrame:
    """(node, component): the least node that edges reach in either direction; lone `nodes` are their own."""
    both = stored(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("component")).withColumnRenamed("x", node)
    if nodes is not None:
        labels = labels.union(nodes.select(node).distinct().join(labels.select(node), node, "left_anti").select(node, F.col(node).alias("component")))
    labels = stored(labels)
    while True:
        near = both.join(labels.withColumnRenamed(node, "y"), "y").groupBy("x").agg(F.min("component").alias("_near")).withColumnRenamed("x", node)
        taken = labels.join(near, node, "left").select(node, F.least("component", F.coalesce("_near", "component")).alias("component"), F.col("component").alias("_was"))
        jump = taken.select(F.col(node).alias("component"), F.col("component").alias("_to"))
        new = stored(taken.join(jump, "component").select(node, F.col("_to").alias("component"), (F.col("_to") != F.col("_was")).alias("_moved")))
        labels = new.select(node, "component")
        if not new.where("_moved").limit(1).count():
            return labels


def fastest_edges(edges: DataFrame, u: str, v: str, t: str, least: float = 0.02) -> DataFrame:
    """Without loops and edges of less than `least`, the fastest of each pair."""
    return edges.where((F.col(u) != F.col(v)) & (F.col(t) >= least)).groupBy(u, v).agg(F.min(t).alias(t))


def shortest_paths(edges: DataFrame, o: str, d: str, t: str, rounds: int | None = None) -> DataFrame:
    """(o, d, t) of all pairs that edges reach, by relaxing from both ends of known paths.

    A round joins paths with paths, so lengths double and rounds are the
    logarithm of the longest path's edges. It stops when no time falls, or
    after `rounds`.
    """
    best = stored(edges.where(F.col(o) != F.col(d)).groupBy(o, d).agg(F.min(t).alias(t)))
    done = 0
    while rounds is None or done < rounds:
        left, right = best.select(F.col(o).alias("_a"), F.col(d).alias("_m"), F.col(t).alias("_t")), best.select(F.col(o).alias("_m"), F.col(d).alias("_b"), F.col(t).alias("_s"))
        longer = left.join(right, "_m").where("_a <> _b").groupBy("_a", "_b").agg(F.min(F.col("_t") + F.col("_s")).alias("_new"))
        joined = longer.join(best, (F.col("_a") == F.col(o)) & (F.col("_b") == F.col(d)), "full_outer")
        found = F.least(F.col(t), F.col("_new"))
        new = stored(joined.select(F.coalesce(o, "_a").alias(o), F.coalesce(d, "_b").alias(d), found.alias(t), (F.col(t).isNull() | (found < F.col(t) - 1e-12)).alias("_better")))
        best, done = new.select(o, d, t), done + 1
        if not new.where("_better").limit(1).count():
            break
    return best


def half_median(edges: DataFrame, t: str) -> Column:
    """Intrazonal cost: half the median positive edge time, a scalar."""
    return F.lit(edges.where(F.col(t) > 0).agg(F.median(t) / 2).first()[0])


def soft_values(edges: DataFrame, destinations: DataFrame, theta: float, rounds: int, t: str = "t_min") -> DataFrame:
    """(dest, i, z): for each destination z = 1 there and elsewhere the sum over edges (i, m) of w z(m), w = max(t, 1.001)^-theta, after `rounds`.

    The edges are read once; only the values move, keyed by node.
    """
    w = edges.select(F.col("grid_o").alias("i"), F.col("grid_d").alias("m"), F.pow(F.greatest(F.col(t), F.lit(1.001)), F.lit(-theta)).alias("w"))
    z = destinations.select(F.col("dest"), F.col("dest").alias("i"), F.lit(1.0).alias("z"))
    for k in range(rounds):
        step = w.join(z.withColumnRenamed("i", "m"), "m").groupBy("dest", "i").agg(F.sum(F.col("w") * F.col("z")).alias("z"))
        z = step.where("i <> dest").unionByName(destinations.select("dest", F.col("dest").alias("i"), F.lit(1.0).alias("z")))
        if k % 4 == 3:
            z = stored(z)
    return z


def soft_flows(edges: DataFrame, z: DataFrame, od: DataFrame, theta: float, rounds: int, t: str = "t_min") -> DataFrame:
    """Expected flow of each edge: walkers to a destination choose edge (i, j) with probability w z(j) / z(i)."""
    w = edges.select(F.col("grid_o").alias("i"), F.col("grid_d").alias("j"), F.pow(F.greatest(F.col(t), F.lit(1.001)), F.lit(-theta)).alias("w"))
    zi, zj = z.where("z > 1e-12").withColumnRenamed("z", "zi"), z.select("dest", F.col("i").alias("j"), F.col("z").alias("zj"))
    p = stored(w.join(zi, "i").join(zj, ["dest", "j"]).where("i <> dest").select("dest", "i", "j", F.least(F.lit(1.0), F.col("w") * F.col("zj") / F.col("zi")).alias("p")))
    source = od.where("home <> work").select(F.col("work").alias("dest"), F.col("home").alias("i"), F.col("pop").alias("v"))
    visits = source.groupBy("dest", "i").agg(F.sum("v").alias("v"))
    start = visits
    for k in range(rounds):
        moved = p.join(visits, ["dest", "i"]).select("dest", F.col("j").alias("i"), (F.col("v") * F.col("p")).alias("v"))
        visits = start.union(moved).groupBy("dest", "i").agg(F.sum("v").alias("v"))
        if k % 4 == 3:
            visits = stored(visits)
    return p.join(visits, ["dest", "i"]).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("p")).alias("flow"))


def degrees(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Incidences of each node."""
    return edges.select(F.explode(F.array(u, v)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def path_flows(edges: DataFrame, paths: DataFrame, od: DataFrame, o: str, d: str, t: str) -> DataFrame:
    """All-or-nothing flows: every trip takes, from each node, the edge of least id that a shortest path begins with."""
    on = edges.groupBy(o, d).agg(F.min(t).alias("_t")).select(F.col(o).alias("_i"), F.col(d).alias("_j"), "_t")
    rest = paths.select(F.col(o).alias("_j"), F.col(d).alias("_dest"), F.col(t).alias("_rest"))
    total = paths.select(F.col(o).alias("_i"), F.col(d).alias("_dest"), F.col(t).alias("_all"))
    inner = on.join(rest, "_j").select("_i", "_j", "_dest", (F.col("_t") + F.col("_rest")).alias("_via"))
    direct = on.select("_i", "_j", F.col("_j").alias("_dest"), F.col("_t").alias("_via"))
    fits = inner.where("_i <> _dest").unionByName(direct).join(total, ["_i", "_dest"]).where(F.abs(F.col("_via") - F.col("_all")) < 1e-9)
    step = stored(fits.groupBy("_i", "_dest").agg(F.min("_j").alias("_j")))
    at = od.where("home <> work").select(F.col("home").alias("_i"), F.col("work").alias("_dest"), F.col("pop").alias("v"))
    parts = []
    while True:
        moved = stored(step.join(at.groupBy("_i", "_dest").agg(F.sum("v").alias("v")), ["_i", "_dest"]))
        if not moved.limit(1).count():
            break
        parts.append(moved)
        at = moved.where("_j <> _dest").select(F.col("_j").alias("_i"), "_dest", "v")
    flows = parts[0] if parts else moved
    for x in parts[1:]:
        flows = flows.unionByName(x)
    return flows.groupBy(F.col("_i").alias("i"), F.col("_j").alias("j")).agg(F.sum("v").alias("flow"))


def suspicious_nodes(incidences: DataFrame) -> DataFrame:
    """Nodes of degree 4 where two roads pass straight (their two bearings differ by 150 degrees or more), rated by the lesser angle.

    `incidences`: node, road, bearing. Such a node may join two roads that
    only cross.
    """
    from roadloom.functions.columns import angle_difference

    road = incidences.groupBy("node", "road").agg(F.count("*").alias("n"), F.min("bearing").alias("lo"), F.max("bearing").alias("hi"))
    straight = road.withColumn("straight", angle_difference(F.col("lo"), F.col("hi")))
    node = straight.groupBy("node").agg(F.sum("n").alias("degree"), F.count("*").alias("roads"), F.min("n").alias("least"), F.min("straight").alias("angle"))
    odd = node.where("degree = 4 AND roads = 2 AND least = 2 AND angle >= 150")
    return odd.select("node", "angle", F.when(F.col("angle") >= 178, "high").when(F.col("angle") >= 165, "medium").otherwise("low").alias("confidence"))


def numbered_nodes(ids: DataFrame, key: str) -> DataFrame:
    """0-based index in text order; for tables of cells, whose number the grid fixes."""
    return ids.select(key).distinct().withColumn("node_i", F.row_number().over(Window.orderBy(F.col(key).cast("string"))) - 1)
