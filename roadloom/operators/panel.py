"""Speed panels, peaks, directional asymmetry and reversal candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.columns import is_am, is_freeflow, is_pm, period, ratio, relative_difference, symmetric_ratio

PANEL_KEYS = ["cline_id", "dir", "weekday_label", "hour_of_day"]


def valid(obs: DataFrame) -> DataFrame:
    """Matched observations with a positive length and speed and a time."""
    return obs.where("matched = 1 AND seg_len_m > 0 AND speed > 0 AND dt IS NOT NULL")


def speed_panel(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Space-mean speed, total length over total time; one shuffle on the keys after partial sums."""
    time = F.col("seg_len_m") / F.col("speed")
    out = valid(obs).groupBy(*(keys or PANEL_KEYS)).agg(F.sum("seg_len_m").alias("total_dist_m"), F.sum(time).alias("total_time_h"), F.count("*").alias("n_obs"))
    return out.withColumn("cl_speed_kmh", ratio(F.col("total_dist_m"), F.col("total_time_h")))


def peak_by_hour_means(panel: DataFrame) -> DataFrame:
    """Weekday peak speed as the plain mean of hourly speeds, a column for each peak."""
    h, v = F.col("hour_of_day"), F.col("cl_speed_kmh")
    days = panel.where((F.col("weekday_label") == "weekday") & (is_am(h) | is_pm(h)))
    return days.groupBy("cline_id", "dir").agg(F.avg(F.when(is_am(h), v)).alias("speed_am"), F.avg(F.when(is_pm(h), v)).alias("speed_pm"))


def peak_by_totals(panel: DataFrame) -> DataFrame:
    """AM and PM from weekdays, free flow from all days, as totals summed again and divided."""
    h = F.col("hour_of_day")
    week = F.col("weekday_label") == "weekday"
    name = F.when(week & is_am(h), "AM").when(week & is_pm(h), "PM").when(is_freeflow(h), "FF_2205")
    sums = panel.withColumn("period", name).where("period IS NOT NULL").groupBy("cline_id", "dir", "period").agg(F.sum("total_dist_m").alias("d"), F.sum("total_time_h").alias("t"))
    return sums.select("cline_id", "dir", "period", ratio(F.col("d"), F.col("t")).alias("speed_kmh"))


def harmonic(v: Column) -> Column:
    """N / sum(1/v) over positive values."""
    ok = v > 0
    return ratio(F.sum(F.when(ok, 1.0)), F.sum(F.when(ok, 1 / v)))


def weighted_mean(v: Column, w: Column) -> Column:
    """Over rows with a value and a positive weight."""
    ok = v.isNotNull() & (w > 0)
    return ratio(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def direction_pairs(peaks: DataFrame) -> DataFrame:
    """A row for each corridor and peak with AB and BA speeds; corridors without any speed have none."""
    long = peaks.select("cline_id", "dir", F.expr("stack(2, 'AM', speed_am, 'PM', speed_pm) AS (peak, speed)")).where("speed IS NOT NULL")
    return long.groupBy("cline_id", "peak").pivot("dir", ["AB", "BA"]).avg("speed").withColumnsRenamed({"AB": "speed_ab", "BA": "speed_ba"})


def with_asymmetry(pairs: DataFrame) -> DataFrame:
    """Ratios, threshold flags (null unless both directions have a speed), missing patterns and the faster direction."""
    a, b = F.col("speed_ab"), F.col("speed_ba")
    ok = (a > 0) & (b > 0)
    r, r2 = symmetric_ratio(a, b), relative_difference(a, b)
    return pairs.select(
        "*", r.alias("ratio"), r2.alias("ratio2"), F.when(ok, r < 0.5).alias("unsym1"), F.when(ok, r < 1 / 3).alias("unsym2"), F.when(ok, r2 > 0.6).alias("unsym3"),
        (a.isNull() != b.isNull()).alias("miss_one_dir"), (a.isNull() & b.isNull()).alias("miss_both"), F.when(ok, F.when(a > b, "AB").otherwise("BA")).alias("faster_dir"),
    )


def reversal_candidates(asym: DataFrame, most: float = 0.5) -> DataFrame:
    """Corridors whose faster direction reverses from AM to PM while both peaks are asymmetric."""
    side = lambda p, s: asym.where(F.col("peak") == p).select("cline_id", F.col("faster_dir").alias(f"faster_{s}"), F.col("ratio").alias(f"ratio_{s}"))
    both = side("AM", "am").join(side("PM", "pm"), "cline_id")
    turned = F.coalesce(F.col("faster_am") != F.col("faster_pm"), F.lit(False))
    asym_am, asym_pm = (F.coalesce(F.col(f"ratio_{s}") < most, F.lit(False)) for s in ("am", "pm"))
    return both.select("*", turned.alias("reversed"), asym_am.alias("asym_am"), asym_pm.alias("asym_pm"), (turned & asym_am & asym_pm).alias("candidate"))


def with_period(panel: DataFrame) -> DataFrame:
    h = F.col("hour_of_day")
    return panel.select("*", period(h).alias("period"), is_am(h).alias("is_am_peak"), is_pm(h).alias("is_pm_peak"), is_freeflow(h).alias("is_freeflow"), F.coalesce(F.col("cl_speed_kmh") > 0, F.lit(False)).alias("has_valid_speed"))


def fallback_speeds(obs: DataFrame, key: str, hour: str, speed: str) -> DataFrame:
    """One pass of mergeable sums (n, sum 1/v) for all, AM, PM and free flow; a period falls back to free flow, all and the network's speed."""
    h, v = F.col(hour), F.col(speed)
    inside = {"am": is_am(h), "pm": is_pm(h), "ff": is_freeflow(h), "all": F.lit(True)}
    speeds = obs.groupBy(key).agg(*[harmonic(F.when(w, v)).alias(n) for n, w in inside.items()])
    network = obs.agg(harmonic(v).alias("network"))  # one row
    both = speeds.join(F.broadcast(network), how="cross")
    up = lambda n: F.coalesce(*[F.when(F.col(x) > 0, F.col(x)) for x in (n, "ff", "all", "network")])
    return both.select(key, up("am").alias("speed_am"), up("pm").alias("speed_pm"), up("ff").alias("speed_ff"))
