"""Fixed points, tessellations and seeds against definitions and brute force."""

import numpy as np
import pandas as pd

from roadloom.functions import geometry as G
from roadloom.operators import equilibrium as E
from roadloom.operators import network as N
from roadloom.operators import spatial as S


def test_soft_routes_of_a_triangle():
    """Two ways of equal cost from the first node to the third: half of ten trips on each."""
    p = E.Parameters(theta=1.0)
    net = E.Network(3, np.array([0, 1, 0]), np.array([1, 2, 2]), np.array([2]), p)
    w, z = net.values(np.array([2.0, 2.0, 4.0]))
    assert np.allclose(z[:, 0], [0.5, 0.5, 1])
    source = np.zeros((3, 1))
    source[0, 0] = 10
    assert np.allclose(net.flows(w, z, source), [5, 5, 5])


def test_values_solve_the_linear_system():
    rng = np.random.default_rng(4)
    n, p = 12, E.Parameters(theta=2.5)
    i, j = np.nonzero(rng.random((n, n)) < 0.3)
    i, j = i[i != j], j[i != j]
    t = 2 + rng.random(len(i)) * 3
    net = E.Network(n, i, j, np.arange(n), p)
    w, z = net.values(t)
    for d in range(n):
        a = np.eye(n)
        np.add.at(a, (i, j), -w)
        a[d] = np.eye(n)[d]
        assert np.allclose(z[:, d], np.linalg.solve(a, np.eye(n)[d]), atol=1e-8)


def test_fundamentals_reproduce_places():
    rng = np.random.default_rng(5)
    k, p = rng.random((6, 6)) + 0.1, E.Parameters()
    r, j = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(6))
    u, a = E.inverted(k, r, j, p)
    share = u[:, None] * k * a[None, :]
    share /= share.sum()
    assert np.allclose(share.sum(axis=1), r, atol=1e-8) and np.allclose(share.sum(axis=0), j, atol=1e-8)


def test_equilibrium_is_a_fixed_point(spark):
    rng = np.random.default_rng(6)
    pairs = [(i, j) for i in range(7) for j in range(7) if i != j and rng.random() < 0.5]
    edges = pd.DataFrame([("s", 0.15, i, j, 2.0 + (3 * i + j) % 4, 1.5 + (3 * i + j) % 4, 1.0 + (i + j) % 3) for i, j in pairs], columns=["scenario", "lambda", "grid_o", "grid_d", "t_min", "t_ff", "lane"])
    od = pd.DataFrame([(i, j, 1.0 + (i * j) % 5) for i in range(7) for j in range(7)], columns=["home", "work", "pop"])
    p = E.Parameters(theta=2.0)
    got = E.solved(spark.createDataFrame(edges), spark.createDataFrame(od), p).toPandas().sort_values(["grid_o", "grid_d"]).reset_index(drop=True)
    assert got["converged"].all() and len(got) == len(pairs)
    order = edges.sort_values(["grid_o", "grid_d"]).reset_index(drop=True)
    new = order["t_ff"] * (got["flow"] / order["lane"]) ** 0.15
    assert np.abs(np.log(new) - np.log(got["t_min"])).max() < 1e-5
    twice = E.solved(spark.createDataFrame(pd.concat([edges, edges.assign(scenario="other", lane=edges["lane"] + 1)])), spark.createDataFrame(od), p).toPandas()
    assert set(twice["scenario"]) == {"s", "other"} and twice.groupby("scenario")["welfare"].first()["other"] > twice.groupby("scenario")["welfare"].first()["s"]


def test_voronoi_polygons_hold_what_is_nearest(spark):
    rng = np.random.default_rng(7)
    seeds = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((40, 2)) * 100)]
    rings = {r.seed: r.ring for r in N.voronoi_polygons(spark.createDataFrame(seeds, "seed long, x double, y double"), "seed", 150.0).select("seed", N.repaired(G.F.col("ring")).alias("ring")).collect()}
    at = np.array([s[1:] for s in seeds])

    def inside(ring, p):
        q = [*ring[1:], ring[0]]
        return all((b.x - a.x) * (p[1] - a.y) - (b.y - a.y) * (p[0] - a.x) >= -1e-9 for a, b in zip(ring, q, strict=True))

    for p in rng.random((200, 2)) * 100:
        d = np.hypot(*(at - p).T)
        holding = {k for k, ring in rings.items() if inside(ring, p)}
        assert int(d.argmin()) in holding and all(d[k] < d.min() + 1e-6 for k in holding)


def test_seeds_are_spaced_and_cover(spark):
    rng = np.random.default_rng(8)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((150, 2)) * 100)]
    seeds = [(r.id, r.x, r.y) for r in S.poisson_seeds(spark.createDataFrame(points, "id long, x double, y double"), "id", 12.0).collect()]
    d = lambda a, b: np.hypot(a[1] - b[1], a[2] - b[2])
    assert all(d(a, b) >= 12 for a in seeds for b in seeds if a[0] < b[0])
    assert all(any(d(p, s) < 12 for s in seeds) for p in points)
