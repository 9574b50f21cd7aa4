"""Fixed points of the spatial model taken to their tolerances, a scenario to a task.

Hundreds of short rounds over tables that the grid bounds are no work for a
cluster, while scenarios are independent: each scenario's edges and flows go
to one task, which iterates on arrays. A task holds cells x destinations
numbers, whatever the size of the data that the flows were summed from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


@dataclass(frozen=True)
class Parameters:
    """Elasticities, damping and the tolerances and rounds at which the fixed points end."""

    theta: float = 6.83
    alpha: float = -0.12
    beta: float = -0.10
    lam: float = 0.15
    damping: float = 0.35
    soft_tol: float = 1e-10
    soft_rounds: int = 2000
    invert_tol: float = 1e-10
    invert_rounds: int = 500
    people_tol: float = 1e-10
    people_rounds: int = 1000
    tol: float = 1e-6
    rounds: int = 100


class Network:
    """Edges i -> j over n nodes and the destinations of the flows."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, dest: np.ndarray, p: Parameters):
        self.n, self.i, self.j, self.dest, self.p = n, i, j, dest, p
        self.at = (dest, np.arange(len(dest)))

    def values(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edge weights max(t, 1.001)^-theta, and z of every node for every destination: 1 there, elsewhere the weighted sum over edges."""
        w = np.maximum(t, 1.001) ** -self.p.theta
        z = np.zeros((self.n, len(self.dest)))
        z[self.at] = 1
        for _ in range(self.p.soft_rounds):
            new = np.zeros_like(z)
            np.add.at(new, self.i, w[:, None] * z[self.j])
            new[self.at] = 1
            moved, z = np.abs(new - z).max(initial=0), new
            if moved < self.p.soft_tol:
                break
        return w, z

    def flows(self, w: np.ndarray, z: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Expected flow of each edge, of `source` trips by node and destination; trips without a way stay out."""
        share = np.where(z[self.i] > 0, w[:, None] * z[self.j] / np.where(z[self.i] > 0, z[self.i], 1), 0)
        share[self.i[:, None] == self.dest[None, :]] = 0
        start = np.where(z > 0, source, 0)
        start[self.at] = 0
        visits, scale = start, max(1.0, start.max(initial=0))
        for _ in range(self.p.soft_rounds):
            new = start.copy()
            np.add.at(new, self.j, share * visits[self.i])
            moved, visits = np.abs(new - visits).max(initial=0) / scale, new
            if moved < self.p.soft_tol:
                break
        return (share * visits[self.i]).sum(axis=1)


def inverted(k: np.ndarray, residents: np.ndarray, jobs: np.ndarray, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """Amenities u and productivities a, each over its geometric mean, that give these residents and jobs; k is access by node and destination."""
    u, a = np.ones(len(residents)), np.ones(len(jobs))
    mean = lambda x: np.maximum(x, EPS) / np.exp(np.log(np.maximum(x, EPS)).mean())
    for _ in range(p.invert_rounds):
        new_u = mean(residents / np.maximum(k @ a, EPS))
        new_a = mean(jobs / np.maximum(k.T @ new_u, EPS))
        moved = max(np.abs(np.log(new_u / u)).max(), np.abs(np.log(new_a / a)).max())
        u, a = new_u, new_a
        if moved < p.invert_tol:
            break
    return u, a


def settled(k: np.ndarray, u: np.ndarray, a: np.ndarray, residents: np.ndarray, jobs: np.ndarray, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, bool]:
    """(residents, jobs, shares by node and destination, welfare, whether it ended): shares go with u R^(theta beta) a J^(theta alpha) k, half of the way each round."""
    for _ in range(p.people_rounds):
        m = (u * np.maximum(residents, EPS) ** (p.theta * p.beta))[:, None] * k * (a * np.maximum(jobs, EPS) ** (p.theta * p.alpha))[None, :]
        share = m / max(m.sum(), EPS)
        r, j = 0.5 * residents + 0.5 * share.sum(axis=1), 0.5 * jobs + 0.5 * share.sum(axis=0)
        r, j = r / r.sum(), j / j.sum()
        moved = max(np.abs(r - residents).max(), np.abs(j - jobs).max())
        residents, jobs = r, j
        if moved < p.people_tol:
            return residents, jobs, share, float(m.sum() ** (1 / p.theta)), True
    return residents, jobs, share, float(m.sum() ** (1 / p.theta)), False


def equilibrium(edges: pd.DataFrame, od: pd.DataFrame, p: Parameters) -> tuple[pd.DataFrame, dict]:
    """Edges with their time and flow, and the summary, where routes, places and times of travel agree.

    edges: grid_o, grid_d, t_min, t_ff, lane_obs, lane; od: home, work, pop.
    Fundamentals are those of the observed times; only pairs that a way
    connects take part. Edges are taken in order of their cells.
    """
    edges = edges.sort_values(["grid_o", "grid_d"], kind="stable").reset_index(drop=True)
    nodes = np.unique(np.concatenate([edges["grid_o"], edges["grid_d"], od["home"], od["work"]]))
    at = lambda c: np.searchsorted(nodes, c.to_numpy())
    dest = np.unique(at(od["work"]))
    net = Network(len(nodes), at(edges["grid_o"]), at(edges["grid_d"]), dest, p)
    pop = np.zeros((len(nodes), len(dest)))
    np.add.at(pop, (at(od["home"]), np.searchsorted(dest, at(od["work"]))), od["pop"].to_numpy(float))
    t, t_ff, lane = (edges[c].to_numpy(float) for c in ("t_min", "t_ff", "lane"))
    w, z = net.values(t)
    pop = np.where(z > 0, pop, 0)
    total = pop.sum()
    residents, jobs = pop.sum(axis=1) / max(total, EPS), pop.sum(axis=0) / max(total, EPS)
    home = residents > 0
    k = np.where(pop > 0, z, 0)
    u, a = np.zeros(len(nodes)), np.ones(len(dest))
    if total > 0:
        u[home], a = inverted(k[home], residents[home], jobs, p)
        u[home] *= np.maximum(residents[home], EPS) ** (-p.theta * p.beta)
        a = a * np.maximum(jobs, EPS) ** (-p.theta * p.alpha)
    flow, welfare, steps, done, inner = np.zeros(len(t)), 0.0, 0, False, True
    for steps in range(1, p.rounds + 1):  # noqa: B007
        w, z = net.values(t)
        residents, jobs, share, welfare, inner = settled(np.where(pop > 0, z, 0), u, a, residents, jobs, p)
        flow = net.flows(w, z, share * total)
        new = t_ff * np.maximum(flow / np.maximum(lane, 0.25), EPS) ** p.lam
        mixed = np.maximum(p.damping * new + (1 - p.damping) * t, EPS)
        moved = np.abs(np.log(mixed) - np.log(t)).max(initial=0)
        t = mixed
        if moved < p.tol:
            done = True
            break
    tau = np.where(z > 0, np.where(z > 0, z, 1) ** (-1 / p.theta), 0)
    summary = {"welfare": welfare, "avg_edge_time": float(t.mean()) if len(t) else None, "weighted_commute": float((share * tau).sum()) if total > 0 else None, "n_iter": steps, "converged": bool(done and inner)}
    return edges.assign(t_min=t, flow=flow), summary


def solved(scenarios: DataFrame, od: DataFrame, p: Parameters = Parameters(), lam: str = "lambda") -> DataFrame:
    """Edges of every scenario at its equilibrium: scenario, grid_o, grid_d, t_min, flow, and the scenario's summary beside them.

    scenarios: scenario, `lam`, grid_o, grid_d, t_min, t_ff, lane. The flows
    are the same for all and go to each scenario's task.
    """
    names = scenarios.select("scenario").distinct()
    flows = od.select("home", "work", "pop").join(F.broadcast(names.withColumnRenamed("scenario", "_of")))  # as many rows as there are scenarios

    def run(edges: pd.DataFrame, trips: pd.DataFrame) -> pd.DataFrame:
        if not len(edges):
            return pd.DataFrame({c: [] for c in columns})
        out, summary = equilibrium(edges, trips, Parameters(**{**vars(p), "lam": float(edges[lam].iloc[0])}))
        return out.assign(**summary)[columns]

    columns = ["scenario", "grid_o", "grid_d", "t_min", "flow", "welfare", "avg_edge_time", "weighted_commute", "n_iter", "converged"]
    schema = "scenario string, grid_o long, grid_d long, t_min double, flow double, welfare double, avg_edge_time double, weighted_commute double, n_iter long, converged boolean"
    return scenarios.groupBy("scenario").cogroup(flows.groupBy("_of")).applyInPandas(run, schema)


def top_edges(edges: DataFrame, score: Column, n: int) -> DataFrame:
    """The n edges of highest score, ties by cells; n bounds what is gathered."""
    return edges.withColumn("score", score).orderBy(F.desc("score"), "grid_o", "grid_d").limit(n)


def against_baseline(summaries: DataFrame, baseline: str, columns: list[str], by: str = "lambda") -> DataFrame:
    """Change of each column in hundredths against the baseline scenario of the same `by`; a few scenario rows."""
    w = Window.partitionBy(by)
    first = lambda c: F.max(F.when(F.col("scenario").startswith(baseline), F.col(c))).over(w)
    return summaries.select("*", *[((F.col(c) / first(c) - 1) * 100).alias(f"{c}_change_pct") for c in columns])
