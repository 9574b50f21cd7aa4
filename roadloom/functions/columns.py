"""Scalar expressions: built-in column functions only, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_R = 6378137.0

# Compass phrases, in the order in which a phrase is searched for them, with degrees.
COMPASS = [("北", 0.0), ("东北", 45.0), ("东", 90.0), ("东南", 135.0), ("南", 180.0), ("西南", 225.0), ("西", 270.0), ("西北", 315.0)]
#: `X向Y`: compass letters on both sides; the second side, two letters at most, is the heading.
_LETTERS = "".join(word for word, _ in COMPASS if len(word) == 1)
DIRECTION_PATTERN = rf"[{_LETTERS}]\s*向\s*([{_LETTERS}]{{1,2}})"


def number(x: Column | str) -> Column:
    """A double, or null where it cannot be read as one."""
    return (F.col(x) if isinstance(x, str) else x).try_cast("double")


def time_code(code: Column) -> Column:
    """Timestamp of a numeric YYYYMMDDHHMM, null where it is none."""
    return F.try_to_timestamp(F.round(code).cast("bigint").cast("string"), F.lit("yyyyMMddHHmm"))


def weekday_label(ts: Column) -> Column:
    return F.when(F.weekday(ts) < 5, "weekday").when(ts.isNotNull(), "weekend")


def is_am(hour: Column) -> Column:
    return hour.isin(7, 8)


def is_pm(hour: Column) -> Column:
    return hour.isin(17, 18)


def is_freeflow(hour: Column) -> Column:
    return (hour >= 22) | (hour <= 5)


def period(hour: Column) -> Column:
    """The first period that an hour fits; FF_0005 is behind FF_2205, which covers it."""
    return F.when(is_am(hour), "AM").when(is_pm(hour), "PM").when(is_freeflow(hour), "FF_2205").when(hour <= 5, "FF_0005").otherwise("OTHER")


def ratio(a: Column, b: Column) -> Column:
    """A / b where b is positive, else null."""
    return F.when(b > 0, a / b)


def symmetric_ratio(a: Column, b: Column) -> Column:
    """min(a/b, b/a) of two positive numbers, else null."""
    return F.when((a > 0) & (b > 0), F.least(a / b, b / a))


def relative_difference(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.abs(a - b) / (a + b))


def log_ratio(a: Column, b: Column) -> Column:
    """P23, log form: exp(-|ln a - ln b|)."""
    return F.when((a > 0) & (b > 0), F.exp(-F.abs(F.log(a) - F.log(b))))


def angle_difference(a: Column, b: Column) -> Column:
    """Between 0 and 180 degrees."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def grid_id(text: Column) -> Column:
    """One spelling for each grid id; ids that a table format read as numbers lose `.0` and leading zeros.

    Blank and nan-like texts are null, whole numbers are written without
    fraction or exponent, other numbers plainly, other texts trimmed.
    """
    t = F.trim(text)
    d = t.try_cast("double")
    blank = F.lower(t).isin("", "nan", "none", "<na>")
    endless = d.isin(float("inf"), float("-inf")) | F.isnan(d)
    whole = d == F.floor(d)
    return F.when(blank, None).when(d.isNull(), t).when(endless, None).when(whole, d.cast("decimal(38,0)").cast("string")).otherwise(d.cast("string"))


def direction_degrees(text: Column) -> Column:
    """P10: degrees of the heading that a road's description names.

    The phrase after the last comma counts. `X向Y` gives Y's heading, or null
    where Y is no heading; without it, the first compass word of COMPASS that
    the phrase contains does.
    """
    phrase = F.trim(F.element_at(F.split(text, "[,，]"), -1))
    to = F.regexp_extract(phrase, DIRECTION_PATTERN, 1)
    exact = fallback = F.lit(None).cast("double")
    for word, degrees in reversed(COMPASS):
        exact = F.when(to == word, degrees).otherwise(exact)
        fallback = F.when(phrase.contains(word), degrees).otherwise(fallback)
    return F.when(text.isNull(), None).when(to != "", exact).otherwise(fallback)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH_R


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * EARTH_R


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / EARTH_R)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / EARTH_R)) * 2 - F.lit(1.5707963267948966))


def wkt_points(text: Column) -> Column:
    """Vertices of a WKT line string, 2-D or 3-D; null where it is none."""
    inner = F.regexp_extract(text, r"(?i)^\s*LINESTRING\s*Z?\s*\(([^()]*)\)\s*$", 1)
    point = lambda p: F.struct(F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("y"))
    points = F.transform(F.split(inner, ","), point)
    return F.when((inner != "") & ~F.exists(points, lambda p: p.getField("x").isNull() | p.getField("y").isNull()), points)


def downsampled(points: Column, most: int) -> Column:
    """At most `most` vertices at even steps of rank, the end points included."""
    n = F.size(points)
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (n - 1) / F.lit(float(most - 1))).cast("int"))
    return F.when(n <= most, points).otherwise(F.transform(at, lambda i: F.get(points, i)))


def percent_text(x: Column, digits: int = 2) -> Column:
    """A share as text."""
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))
