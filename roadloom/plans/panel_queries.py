"""Speed panels and directional asymmetry on the proxy observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions.columns import log_ratio, time_code, weekday_label
from roadloom.operators import panel as P
from roadloom.plans import query
from roadloom.sources.tables import table


def observations(spark, sf_dir):
    """Speed observations matched to a directed corridor: the survey's proxy on lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 100).alias("cline_id"),
        F.when(F.col("l_linestatus") == "O", "AB").otherwise("BA").alias("dir"),
        (F.col("l_orderkey") % 24).cast("int").alias("hour_of_day"),
        weekday_label(F.col("l_shipdate")).alias("weekday_label"),
        (F.col("l_quantity") * 10).alias("seg_len_m"),
        (1 + F.col("l_extendedprice") / 1000).alias("speed"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("matched"),
        F.col("l_shipdate").alias("dt"),
    )


OBS = """obs AS (SELECT l_partkey % 100 AS cline_id, CASE WHEN l_linestatus = 'O' THEN 'AB' ELSE 'BA' END AS dir,
 CAST(l_orderkey % 24 AS INTEGER) AS hour_of_day, CASE WHEN isodow(l_shipdate) <= 5 THEN 'weekday' ELSE 'weekend' END AS weekday_label,
 l_quantity * 10 AS seg_len_m, 1 + l_extendedprice / 1000 AS speed, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS matched, l_shipdate AS dt FROM lineitem),
ok AS (SELECT * FROM obs WHERE matched = 1 AND seg_len_m > 0 AND speed > 0 AND dt IS NOT NULL)"""
PANEL = OBS + """, panel AS (SELECT cline_id, dir, weekday_label, hour_of_day, sum(seg_len_m) AS total_dist_m, sum(seg_len_m / speed) AS total_time_h, count(*) AS n_obs,
 sum(seg_len_m) / sum(seg_len_m / speed) AS cl_speed_kmh FROM ok GROUP BY ALL)"""
PEAKS = PANEL + """, peaks AS (SELECT cline_id, dir, avg(cl_speed_kmh) FILTER (hour_of_day IN (7, 8)) AS speed_am, avg(cl_speed_kmh) FILTER (hour_of_day IN (17, 18)) AS speed_pm
 FROM panel WHERE weekday_label = 'weekday' AND hour_of_day IN (7, 8, 17, 18) GROUP BY ALL)"""
ASYM = PEAKS + """, long AS (SELECT cline_id, dir, 'AM' AS peak, speed_am AS v FROM peaks UNION ALL SELECT cline_id, dir, 'PM', speed_pm FROM peaks),
pairs AS (SELECT cline_id, peak, avg(v) FILTER (dir = 'AB') AS speed_ab, avg(v) FILTER (dir = 'BA') AS speed_ba FROM long WHERE v IS NOT NULL GROUP BY ALL),
asym AS (SELECT *, CASE WHEN speed_ab > 0 AND speed_ba > 0 THEN least(speed_ab / speed_ba, speed_ba / speed_ab) END AS ratio,
 CASE WHEN speed_ab > 0 AND speed_ba > 0 THEN abs(speed_ab - speed_ba) / (speed_ab + speed_ba) END AS ratio2,
 CASE WHEN speed_ab > 0 AND speed_ba > 0 THEN CASE WHEN speed_ab > speed_ba THEN 'AB' ELSE 'BA' END END AS faster_dir FROM pairs)"""


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def panel(spark, sf_dir):
    return P.speed_panel(observations(spark, sf_dir))


def asymmetry(spark, sf_dir):
    return P.with_asymmetry(P.direction_pairs(P.peak_by_hour_means(panel(spark, sf_dir))))


@query("speed_panel", f"WITH {PANEL} SELECT cline_id, dir, weekday_label, hour_of_day, round(total_dist_m, 6) AS total_dist_m, round(total_time_h, 6) AS total_time_h, n_obs, round(cl_speed_kmh, 6) AS cl_speed_kmh FROM panel")
def speed_panel(spark, sf_dir):
    return rounded(panel(spark, sf_dir))


@query("speed_panel_period", f"""WITH {PANEL} SELECT cline_id, dir, weekday_label, hour_of_day, n_obs, round(cl_speed_kmh, 6) AS cl_speed_kmh,
 CASE WHEN hour_of_day IN (7, 8) THEN 'AM' WHEN hour_of_day IN (17, 18) THEN 'PM' WHEN hour_of_day >= 22 OR hour_of_day <= 5 THEN 'FF_2205' ELSE 'OTHER' END AS period,
 hour_of_day IN (7, 8) AS is_am_peak, hour_of_day IN (17, 18) AS is_pm_peak, hour_of_day >= 22 OR hour_of_day <= 5 AS is_freeflow, cl_speed_kmh > 0 AS has_valid_speed FROM panel""")
def speed_panel_period(spark, sf_dir):
    return rounded(P.with_period(panel(spark, sf_dir)).drop("total_dist_m", "total_time_h"))


@query("peak_speed_hourmean", f"WITH {PEAKS} SELECT cline_id, dir, round(speed_am, 6) AS speed_am, round(speed_pm, 6) AS speed_pm FROM peaks")
def peak_speed_hourmean(spark, sf_dir):
    return rounded(P.peak_by_hour_means(panel(spark, sf_dir)))


@query("peak_speed_totals", f"""WITH {PANEL}, named AS (SELECT *, CASE WHEN weekday_label = 'weekday' AND hour_of_day IN (7, 8) THEN 'AM' WHEN weekday_label = 'weekday' AND hour_of_day IN (17, 18) THEN 'PM'
 WHEN hour_of_day >= 22 OR hour_of_day <= 5 THEN 'FF_2205' END AS period FROM panel)
SELECT cline_id, dir, period, round(sum(total_dist_m) / sum(total_time_h), 6) AS speed_kmh FROM named WHERE period IS NOT NULL GROUP BY ALL""")
def peak_speed_totals(spark, sf_dir):
    return rounded(P.peak_by_totals(panel(spark, sf_dir)))


@query("freeflow_speed", f"WITH {PANEL} SELECT cline_id, dir, round(sum(total_dist_m) / sum(total_time_h), 6) AS ff_kmh FROM panel WHERE hour_of_day >= 22 OR hour_of_day <= 5 GROUP BY ALL")
def freeflow_speed(spark, sf_dir):
    return rounded(P.peak_by_totals(panel(spark, sf_dir)).where("period = 'FF_2205'").select("cline_id", "dir", F.col("speed_kmh").alias("ff_kmh")))


@query("harmonic_by_road", "SELECT user_id AS roadseg_id, round(count(value) FILTER (value > 0) / sum(1 / value) FILTER (value > 0), 6) AS speed, count(*) AS n FROM events GROUP BY user_id")
def harmonic_by_road(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("roadseg_id")).agg(F.round(P.harmonic(F.col("value")), 6).alias("speed"), F.count("*").alias("n"))


@query("speed_fallback_chain", """WITH e AS (SELECT user_id, hour(ts) AS h, value AS v FROM events), s AS (SELECT user_id,
 count(*) FILTER (h IN (7, 8)) / sum(1 / v) FILTER (h IN (7, 8)) AS am, count(*) FILTER (h IN (17, 18)) / sum(1 / v) FILTER (h IN (17, 18)) AS pm,
 count(*) FILTER (h >= 22 OR h <= 5) / sum(1 / v) FILTER (h >= 22 OR h <= 5) AS ff, count(*) / sum(1 / v) AS al FROM e WHERE v > 0 GROUP BY 1), n AS (SELECT count(*) / sum(1 / v) AS net FROM e WHERE v > 0)
SELECT user_id, round(coalesce(am, ff, al, net), 6) AS speed_am, round(coalesce(pm, ff, al, net), 6) AS speed_pm, round(coalesce(ff, al, net), 6) AS speed_ff FROM s, n""")
def speed_fallback_chain(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.hour("ts").alias("h"), "value")
    return rounded(P.fallback_speeds(e, "user_id", "h", "value"))


@query("speed_summary_groups", f"""WITH {OBS} SELECT weekday_label, count(*) AS n, round(avg(speed), 6) AS mean, round(sum(speed * seg_len_m) / sum(seg_len_m), 6) AS wmean, round(median(speed), 6) AS median,
 round(stddev_samp(speed), 6) AS sd FROM ok GROUP BY GROUPING SETS ((), (weekday_label))""")
def speed_summary_groups(spark, sf_dir):
    """All and by kind of day in one pass: the grouping sets expand rows before the partial sums."""
    ok = P.valid(observations(spark, sf_dir))
    v, w = F.col("speed"), F.col("seg_len_m")
    return rounded(ok.rollup("weekday_label").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), P.weighted_mean(v, w).alias("wmean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd")))


@query("speed_by_period", f"""WITH {PANEL}, p AS (SELECT *, CASE WHEN hour_of_day IN (7, 8) THEN 'AM' WHEN hour_of_day IN (17, 18) THEN 'PM' WHEN hour_of_day >= 22 OR hour_of_day <= 5 THEN 'FF_2205' ELSE 'OTHER' END AS period FROM panel)
SELECT period, weekday_label, count(*) AS n, round(avg(cl_speed_kmh), 6) AS mean, round(quantile_cont(cl_speed_kmh, 0.1), 6) AS p10, round(quantile_cont(cl_speed_kmh, 0.9), 6) AS p90 FROM p GROUP BY ALL""")
def speed_by_period(spark, sf_dir):
    p = P.with_period(panel(spark, sf_dir))
    return rounded(p.groupBy("period", "weekday_label").agg(F.count("*").alias("n"), F.avg("cl_speed_kmh").alias("mean"), F.percentile("cl_speed_kmh", 0.1).alias("p10"), F.percentile("cl_speed_kmh", 0.9).alias("p90")))


@query("speed_definitions", f"""WITH {OBS} SELECT cline_id, round(sum(seg_len_m) / sum(seg_len_m / speed), 6) AS space_mean, round(sum(speed * seg_len_m) / sum(seg_len_m), 6) AS length_weighted,
 round(avg(speed), 6) AS simple_mean, round(count(*) / sum(1 / speed), 6) AS harmonic FROM ok GROUP BY cline_id""")
def speed_definitions(spark, sf_dir):
    v, w = F.col("speed"), F.col("seg_len_m")
    means = {"space_mean": F.sum(w) / F.sum(w / v), "length_weighted": P.weighted_mean(v, w), "simple_mean": F.avg(v), "harmonic": P.harmonic(v)}
    return P.valid(observations(spark, sf_dir)).groupBy("cline_id").agg(*[F.round(x, 6).alias(n) for n, x in means.items()])


@query("direction_pairs", f"WITH {ASYM} SELECT cline_id, peak, round(speed_ab, 6) AS speed_ab, round(speed_ba, 6) AS speed_ba FROM asym")
def direction_pairs(spark, sf_dir):
    return rounded(P.direction_pairs(P.peak_by_hour_means(panel(spark, sf_dir))))


@query("asym_measures", f"""WITH {ASYM} SELECT cline_id, peak, round(speed_ab, 6) AS speed_ab, round(speed_ba, 6) AS speed_ba, round(ratio, 6) AS ratio, round(ratio2, 6) AS ratio2, ratio < 0.5 AS unsym1, ratio < 1.0 / 3 AS unsym2,
 ratio2 > 0.6 AS unsym3, (speed_ab IS NULL) <> (speed_ba IS NULL) AS miss_one_dir, speed_ab IS NULL AND speed_ba IS NULL AS miss_both, faster_dir FROM asym""")
def asym_measures(spark, sf_dir):
    return rounded(asymmetry(spark, sf_dir))


@query("asym_summary", f"""WITH {ASYM} SELECT peak, count(*) AS n_centerlines, count(ratio) AS n_both, count(*) FILTER (ratio < 0.8) AS n_asym, round(100.0 * count(*) FILTER (ratio < 0.8) / nullif(count(ratio), 0), 6) AS pct FROM asym GROUP BY peak""")
def asym_summary(spark, sf_dir):
    """M11 at a threshold of 0.8, where the proxy has cases."""
    a = asymmetry(spark, sf_dir)
    n = a.groupBy("peak").agg(F.count("*").alias("n_centerlines"), F.count("ratio").alias("n_both"), F.count_if(F.col("ratio") < 0.8).alias("n_asym"))
    return n.withColumn("pct", F.round(F.when(F.col("n_both") > 0, 100 * F.col("n_asym") / F.col("n_both")), 6))


@query("asym_am_pm_sets", f"""WITH {ASYM}, am AS (SELECT cline_id FROM asym WHERE peak = 'AM' AND ratio < 0.8), pm AS (SELECT cline_id FROM asym WHERE peak = 'PM' AND ratio < 0.8)
SELECT (SELECT count(*) FROM (SELECT * FROM am EXCEPT SELECT * FROM pm)) AS am_only, (SELECT count(*) FROM (SELECT * FROM pm EXCEPT SELECT * FROM am)) AS pm_only,
 (SELECT count(*) FROM (SELECT * FROM am INTERSECT SELECT * FROM pm)) AS in_both, (SELECT count(*) FROM (SELECT * FROM am UNION SELECT * FROM pm)) AS total""")
def asym_am_pm_sets(spark, sf_dir):
    """Four cardinalities from one aggregate instead of four set operations."""
    hit = asymmetry(spark, sf_dir).where("ratio < 0.8").groupBy("cline_id").agg(F.bool_or(F.col("peak") == "AM").alias("am"), F.bool_or(F.col("peak") == "PM").alias("pm"))
    return hit.agg(F.count_if(F.col("am") & ~F.col("pm")).alias("am_only"), F.count_if(F.col("pm") & ~F.col("am")).alias("pm_only"), F.count_if(F.col("am") & F.col("pm")).alias("in_both"), F.count("*").alias("total"))


@query("asym_by_hour", f"""WITH {PANEL}, w AS (SELECT cline_id, weekday_label, hour_of_day, avg(cl_speed_kmh) FILTER (dir = 'AB') AS ab, avg(cl_speed_kmh) FILTER (dir = 'BA') AS ba, sum(total_dist_m) AS len FROM panel GROUP BY ALL)
SELECT weekday_label, hour_of_day, count(*) AS n, round(sum(abs(ab - ba) / greatest(ab, ba) * len) / sum(len), 6) AS asym FROM w WHERE ab > 0 AND ba > 0 GROUP BY ALL""")
def asym_by_hour(spark, sf_dir):
    """Length-weighted mean of |AB - BA| / max by kind of day and hour."""
    p = panel(spark, sf_dir)
    side = lambda d: F.avg(F.when(F.col("dir") == d, F.col("cl_speed_kmh")))
    w = p.groupBy("cline_id", "weekday_label", "hour_of_day").agg(side("AB").alias("ab"), side("BA").alias("ba"), F.sum("total_dist_m").alias("len")).where("ab > 0 AND ba > 0")
    gap = F.abs(F.col("ab") - F.col("ba")) / F.greatest("ab", "ba")
    return w.groupBy("weekday_label", "hour_of_day").agg(F.count("*").alias("n"), F.round(P.weighted_mean(gap, F.col("len")), 6).alias("asym"))


@query("pair_table_log_ratio", f"WITH {ASYM} SELECT cline_id, peak, round(exp(-abs(ln(speed_ab) - ln(speed_ba))), 6) AS ratio, round(1 - exp(-abs(ln(speed_ab) - ln(speed_ba))), 6) AS intensity FROM asym WHERE speed_ab > 0 AND speed_ba > 0")
def pair_table_log_ratio(spark, sf_dir):
    """The log form of the ratio and the intensity of a reversal."""
    r = log_ratio(F.col("speed_ab"), F.col("speed_ba"))
    return asymmetry(spark, sf_dir).where("ratio IS NOT NULL").select("cline_id", "peak", F.round(r, 6).alias("ratio"), F.round(1 - r, 6).alias("intensity"))


CAND = ASYM + """, two AS (SELECT a.cline_id, a.faster_dir AS faster_am, a.ratio AS ratio_am, p.faster_dir AS faster_pm, p.ratio AS ratio_pm FROM asym a JOIN asym p ON a.cline_id = p.cline_id AND a.peak = 'AM' AND p.peak = 'PM')
SELECT cline_id, faster_am, round(ratio_am, 6) AS ratio_am, faster_pm, round(ratio_pm, 6) AS ratio_pm, coalesce(faster_am <> faster_pm, false) AS reversed, coalesce(ratio_am < 0.8, false) AS asym_am, coalesce(ratio_pm < 0.8, false) AS asym_pm,
 coalesce(faster_am <> faster_pm AND ratio_am < 0.8 AND ratio_pm < 0.8, false) AS candidate FROM two"""


@query("reversal_all", f"WITH {CAND}")
def reversal_all(spark, sf_dir):
    return rounded(P.reversal_candidates(asymmetry(spark, sf_dir), 0.8))


@query("reversal_candidates", f"WITH all_rows AS (WITH {CAND}) SELECT * FROM all_rows WHERE candidate")
def reversal_candidates(spark, sf_dir):
    """Flagship: corridors whose faster direction reverses between the peaks while both are asymmetric."""
    return reversal_all(spark, sf_dir).where("candidate")


@query("diurnal", f"WITH {OBS} SELECT weekday_label, hour_of_day, round(sum(speed * seg_len_m) / sum(seg_len_m), 6) AS speed, count(*) AS n FROM ok GROUP BY ALL")
def diurnal(spark, sf_dir):
    """A44."""
    return P.valid(observations(spark, sf_dir)).groupBy("weekday_label", "hour_of_day").agg(F.round(P.weighted_mean(F.col("speed"), F.col("seg_len_m")), 6).alias("speed"), F.count("*").alias("n"))


@query("timecode_parse", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CASE WHEN isodow(ts) <= 5 THEN 'weekday' ELSE 'weekend' END AS weekday_label, CAST(date_trunc('minute', ts) AS VARCHAR) AS at FROM events
UNION ALL SELECT * FROM (VALUES (CAST(-1 AS BIGINT), CAST(0 AS INTEGER), 'weekday', '2025-05-20 00:00:00'), (-2, 17, 'weekend', '2025-05-24 17:30:00'), (-3, NULL, NULL, NULL), (-4, NULL, NULL, NULL)) AS t(a, b, c, d)""")
def timecode_parse(spark, sf_dir):
    """Numeric time codes back to times; codes that name no time are null."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMddHHmm").cast("double").alias("code"))
    odd = spark.sql("SELECT * FROM VALUES (-1L, 202505200000.0D), (-2L, 202505241730.0D), (-3L, 202513010000.0D), (-4L, CAST(NULL AS DOUBLE)) AS t(event_id, code)")
    t = e.union(odd).withColumn("t", time_code(F.col("code")))
    return t.select("event_id", F.hour("t").alias("hour_of_day"), weekday_label(F.col("t")).alias("weekday_label"), F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("at"))
