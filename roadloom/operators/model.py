"""Gravity and equilibrium: fixed effects, inversion, population, congestion, counterfactuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.graph import soft_flows, soft_values
from roadloom.sources.store import stored

EPS = 1e-12


def demeaned(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """Columns less their means over a group."""
    w = Window.partitionBy(by)
    return df.select(*[c for c in df.columns if c not in cols], *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in cols])


def theta_two_way(od: DataFrame, rounds: int) -> DataFrame:
    """Slope of log flow on log time after taking out origin and destination means in turn; theta = max(0.1, -beta)."""
    df = od.where("pop > 0 AND tau > 0").select("o", "d", F.log("tau").alias("x"), F.log("pop").alias("y"))
    for k in range(rounds):
        df = demeaned(demeaned(df, ["x", "y"], "o"), ["x", "y"], "d")
        if k % 4 == 3:
            df = stored(df)
    beta = F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))
    return df.agg(beta.alias("beta"), F.greatest(F.lit(0.1), -beta).alias("theta"))


def lambda_by_lane(edges: DataFrame) -> DataFrame:
    """Slope of log delay on log density within bins of whole lanes, clipped to [0.01, 1.5]."""
    df = edges.where("t_obs > 0 AND t_ff > 0 AND flow > 0").select(F.greatest(F.lit(1.0), F.rint("lane")).alias("bin"), F.log(F.col("flow") / F.greatest("lane", F.lit(0.5))).alias("x"), F.log(F.col("t_obs") / F.col("t_ff")).alias("y"))
    within = demeaned(df, ["x", "y"], "bin")
    slope = F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))
    return within.agg(F.greatest(F.lit(0.01), F.least(F.lit(1.5), slope)).alias("lambda"))


def geometric(df: DataFrame, col: str) -> DataFrame:
    """A column over its geometric mean."""
    return df.withColumn(col, F.greatest(F.col(col), F.lit(EPS)) / F.exp(F.avg(F.log(F.greatest(F.col(col), F.lit(EPS)))).over(Window.partitionBy())))


def inverted(nodes: DataFrame, costs: DataFrame, theta: float, rounds: int) -> DataFrame:
    """Amenities u and productivities a that reproduce residents and jobs; u first, then a with the new u, each over its geometric mean.

    nodes: node, residents, jobs (shares); costs: o, d, tau.
    """
    k = costs.select("o", "d", F.pow("tau", F.lit(-theta)).alias("k"))
    state = nodes.select("node", "residents", "jobs", F.lit(1.0).alias("u"), F.lit(1.0).alias("a"))
    for i in range(rounds):
        reach = k.join(state.select(F.col("node").alias("d"), "a"), "d").groupBy(F.col("o").alias("node")).agg(F.sum(F.col("k") * F.col("a")).alias("m"))
        state = geometric(state.join(reach, "node").select("node", "residents", "jobs", (F.col("residents") / F.greatest("m", F.lit(EPS))).alias("u"), "a"), "u")
        reach = k.join(state.select(F.col("node").alias("o"), "u"), "o").groupBy(F.col("d").alias("node")).agg(F.sum(F.col("k") * F.col("u")).alias("m"))
        state = geometric(state.join(reach, "node").select("node", "residents", "jobs", "u", (F.col("jobs") / F.greatest("m", F.lit(EPS))).alias("a")), "a")
        if i % 2 == 1:
            state = stored(state)
    return state


def population(nodes: DataFrame, costs: DataFrame, theta: float, rounds: int, alpha: float = -0.12, beta: float = -0.10, damping: float = 0.5) -> DataFrame:
    """(o, d, share) after `rounds` damped steps: shares go with u R^(theta beta) a J^(theta alpha) tau^-theta.

    nodes: node, u, a, residents, jobs (shares). Residents and jobs are the
    margins of the new shares, mixed with the old by `damping` and set to sum to one.
    """
    k = costs.select("o", "d", F.pow("tau", F.lit(-theta)).alias("k"))
    state = nodes.select("node", "u", "a", "residents", "jobs")
    share = None
    for i in range(rounds):
        left = state.select(F.col("node").alias("o"), (F.col("u") * F.pow(F.greatest("residents", F.lit(EPS)), F.lit(theta * beta))).alias("_l"))
        right = state.select(F.col("node").alias("d"), (F.col("a") * F.pow(F.greatest("jobs", F.lit(EPS)), F.lit(theta * alpha))).alias("_r"))
        mass = k.join(left, "o").join(right, "d").select("o", "d", (F.col("k") * F.col("_l") * F.col("_r")).alias("m"))
        mass = stored(mass)
        total = mass.agg(F.sum("m").alias("total"))  # one row
        share = stored(mass.join(F.broadcast(total)).select("o", "d", (F.col("m") / F.col("total")).alias("share"), "total"))
        res = share.groupBy(F.col("o").alias("node")).agg(F.sum("share").alias("_res"))
        job = share.groupBy(F.col("d").alias("node")).agg(F.sum("share").alias("_job"))
        mix = lambda new, old: (1 - damping) * F.col(old) + damping * F.coalesce(new, F.lit(0.0))
        state = state.join(res, "node", "left").join(job, "node", "left").select("node", "u", "a", mix("_res", "residents").alias("residents"), mix("_job", "jobs").alias("jobs"))
        one = Window.partitionBy()
        state = stored(state.select("node", "u", "a", (F.col("residents") / F.sum("residents").over(one)).alias("residents"), (F.col("jobs") / F.sum("jobs").over(one)).alias("jobs")))
    return share


def congested_times(edges: DataFrame, lam: float, damping: float = 0.35) -> DataFrame:
    """M22, one step: t = t_ff (flow / lanes)^lambda, mixed with the old time; lanes are 0.25 at least."""
    new = F.col("t_ff") * F.pow(F.greatest(F.col("flow"), F.lit(EPS)) / F.greatest("lane", F.lit(0.25)), F.lit(lam))
    return edges.withColumn("t_new", (1 - damping) * F.col("t_min") + damping * F.greatest(new, F.col("t_ff") * 0 + EPS))


def equilibrium(edges: DataFrame, od: DataFrame, theta: float, lam: float, steps: int, soft_rounds: int) -> DataFrame:
    """Edges with flow and time after `steps` of soft assignment and congestion; each step is written."""
    dests = od.select(F.col("work").alias("dest")).distinct()
    state = edges.withColumn("flow", F.lit(0.0))
    for _ in range(steps):
        base = state.drop("flow")
        z = stored(soft_values(base, dests, theta, soft_rounds))
        flows = soft_flows(base, z, od, theta, soft_rounds).select(F.col("i").alias("grid_o"), F.col("j").alias("grid_d"), "flow")
        joined = base.join(flows, ["grid_o", "grid_d"], "left").fillna(0.0, ["flow"])
        state = stored(congested_times(joined, lam).withColumn("t_min", F.col("t_new")).drop("t_new"))
    return state


def top_congested(edges: DataFrame, n: int) -> DataFrame:
    """The n edges of highest flow t / max(lane, 0.5), ties by cells."""
    return edges.withColumn("score", F.col("flow") * F.col("t_min") / F.greatest("lane", F.lit(0.5))).orderBy(F.desc("score"), "grid_o", "grid_d").limit(n)


def reallocated(edges: DataFrame, treated: DataFrame, add: float = 1.0) -> DataFrame:
    """Treated edges gain `add` lanes, their reverse edges lose as many and keep 0.25."""
    plus = treated.select("grid_o", "grid_d", F.lit(add).alias("_plus"))
    minus = treated.select(F.col("grid_d").alias("grid_o"), F.col("grid_o").alias("grid_d"), F.lit(add).alias("_minus"))
    both = edges.join(plus, ["grid_o", "grid_d"], "left").join(minus, ["grid_o", "grid_d"], "left")
    gained = F.col("lane") + F.coalesce("_plus", F.lit(0.0))
    return both.withColumn("lane", F.when(F.col("_minus").isNotNull(), F.greatest(F.lit(0.25), gained - F.col("_minus"))).otherwise(gained)).drop("_plus", "_minus")


def equilibrium_summary(edges: DataFrame, tau: Column | None = None) -> DataFrame:
    """M25."""
    w = F.col("flow")
    return edges.agg(F.avg("t_min").alias("avg_edge_time"), (F.sum(F.col("t_min") * w) / F.sum(w)).alias("flow_weighted_time"), F.sum(w).alias("total_flow"), F.max("t_min").alias("max_time"))
