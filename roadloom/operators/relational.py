"""Joins, ordered operators and aggregates that the stages share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_flag(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is true; a table without the column keeps all."""
    return df.where(F.coalesce(F.col(flag), F.lit(False))) if flag in df.columns else df


def checked_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises at run time where a key is not unique on either side."""
    once = lambda d: d.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    joined = once(left).join(once(right).withColumnRenamed("_n", "_m"), key)
    return joined.where(F.when((F.col("_n") == 1) & (F.col("_m") == 1), True).otherwise(F.raise_error(F.lit(f"{key} is not unique")).cast("boolean"))).drop("_n", "_m")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number of the run that each row is in; `starts` tells, from lagged values, where a run begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merged_cuts(cuts: DataFrame, key: str, s: str, length: str, distance: float) -> DataFrame:
    """Cut positions inside a line, those within `distance` of the one before merged into their mean."""
    w = Window.partitionBy(key).orderBy(s)
    inner = cuts.where((F.col(s) > 1) & (F.col(s) < F.col(length) - 1))
    gap = F.col(s) - F.lag(s).over(w)
    return islands(inner.withColumn("_gap", gap), [key], [s], F.col("_gap") > distance).groupBy(key, "island").agg(F.avg(s).alias(s), F.count("*").alias("n"))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str, measure: str) -> DataFrame:
    """Consecutive rows of one value as one row, with the sum of `measure` and the run's number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)
    out = islands(df.withColumn("_new", changed), keys, order, F.col("_new"), "run")
    return out.groupBy(*keys, "run", value).agg(F.sum(measure).alias(measure))


def consecutive(df: DataFrame, keys: list[str], order: list[str], value: str, measure: str) -> DataFrame:
    """Each row of a sequence with the next one's value; the measure is that of the first."""
    nxt = F.lead(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.select(*keys, F.col(value).alias("grid_o"), nxt.alias("grid_d"), measure).where("grid_d IS NOT NULL")


def change_points(df: DataFrame, keys: list[str], s: str, value: str) -> DataFrame:
    """Midway positions between samples whose value differs from the previous known one."""
    w = Window.partitionBy(*keys).orderBy(s)
    known = df.where(F.col(value).isNotNull())
    both = known.select(*keys, s, value, F.lag(value).over(w).alias("before"), F.lag(s).over(w).alias("s_before"))
    return both.where(F.col("before") != F.col(value)).select(*keys, ((F.col(s) + F.col("s_before")) / 2).alias("cut"), "before", F.col(value).alias("after"))


def average_rank(value: str, over: list[str] | None = None) -> Column:
    """Average rank of ties as a share of the rows, 0 for the value 0.

    Ranks over a whole table meet in one task; this is for the table of cells, whose size the grid fixes.
    """
    ranked = Window.partitionBy(*(over or [])).orderBy(value)
    ties, all_rows = Window.partitionBy(*(over or []), value), Window.partitionBy(*(over or []))
    share = (F.rank().over(ranked) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(all_rows)
    return F.when(F.col(value) == 0, 0.0).otherwise(share)


def histogram(df: DataFrame, value: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts in equal bins between lo and hi (least and greatest value if not given), the last one closed."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    if lo is None or hi is None:
        found = rows.agg(F.min("v"), F.max("v")).first()
        lo, hi = found[0] if lo is None else lo, found[1] if hi is None else hi
    at = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    return rows.where(F.col("v").between(lo, hi)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n")).withColumn("left_edge", lo + F.col("bin") * ((hi - lo) / bins))


def shares(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by value and their share; the window is over the counts, one row a value."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def home_work_marginals(od: DataFrame, home: str, work: str, pop: str) -> DataFrame:
    """A10: residents, jobs and their ratio for every cell of either; full outer join of two small aggregates."""
    res = od.groupBy(F.col(home).alias("grid_id")).agg(F.sum(pop).alias("residents"))
    jobs = od.groupBy(F.col(work).alias("grid_id")).agg(F.sum(pop).alias("jobs"))
    both = res.join(jobs, "grid_id", "full_outer").fillna(0.0, ["residents", "jobs"])
    return both.withColumn("job_resident_ratio", F.when(F.col("residents") > 0, F.col("jobs") / F.col("residents")))


def suffixed_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join in which columns of both sides, but for the key, are called `_x` on the left and `_y` on the right."""
    both = [c for c in left.columns if c in right.columns and c != key]
    return left.withColumnsRenamed({c: f"{c}_x" for c in both}).join(right.withColumnsRenamed({c: f"{c}_y" for c in both}), key, how)


def harmonised(df: DataFrame) -> DataFrame:
    """Columns `c_x` and `c_y` as one `c`, the left value first."""
    stems = [c[:-2] for c in df.columns if c.endswith("_x") and f"{c[:-2]}_y" in df.columns]
    gone = {f"{c}_{k}" for c in stems for k in "xy"}
    return df.select(*[c for c in df.columns if c not in gone], *[F.coalesce(f"{c}_x", f"{c}_y").alias(c) for c in stems])


def number_list(text: Column) -> Column:
    """The numbers of a text, parted by commas."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
