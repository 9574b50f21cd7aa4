"""Planar geometry on array<struct<x,y>> as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def xy(p: Column) -> tuple[Column, Column]:
    return p.getField("x"), p.getField("y")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polyline(values: Column, n: int, scale: float = 1.0) -> Column:
    """Vertices of a flat array x0, y0, x1, y1, ..."""
    at = lambda i: F.get(values, i).cast("double") * scale
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: point(at(2 * k), at(2 * k + 1)))


def distance(p: Column, q: Column) -> Column:
    (px, py), (qx, qy) = xy(p), xy(q)
    return F.hypot(px - qx, py - qy)


def segments(g: Column) -> Column:
    """Array of (a, b) of consecutive vertices."""
    return F.transform(F.slice(g, F.lit(1), F.greatest(F.size(g) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), F.get(g, i + 1).alias("b")))


def total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)


def length(g: Column) -> Column:
    """G01."""
    return total(F.transform(segments(g), lambda s: distance(s.getField("a"), s.getField("b"))))


def bearing(g: Column) -> Column:
    """Compass bearing from the first to the last vertex, 0 = north, clockwise."""
    (ax, ay), (bx, by) = xy(F.get(g, F.lit(0))), xy(F.element_at(g, -1))
    return F.pmod(F.degrees(F.atan2(bx - ax, by - ay)) + 360.0, F.lit(360.0))


def measured(g: Column) -> Column:
    """Array of (a, b, from, len): segments with the distance from the line's start."""
    start = F.struct(F.lit(0.0).alias("at"), F.expr("CAST(array() AS array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,from:double,len:double>>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        n = distance(s.getField("a"), s.getField("b"))
        row = F.struct(s.getField("a").alias("a"), s.getField("b").alias("b"), acc.getField("at").alias("from"), n.alias("len"))
        return F.struct((acc.getField("at") + n).alias("at"), F.concat(acc.getField("out"), F.array(row)).alias("out"))

    return F.aggregate(segments(g), start, step, lambda acc: acc.getField("out"))


def along(m: Column, s: Column) -> Column:
    """The point at distance s of a measured line, its ends beyond them."""
    seg = F.coalesce(F.get(F.filter(m, lambda q: s <= q.getField("from") + q.getField("len")), F.lit(0)), F.element_at(m, -1))

    def on(q: Column) -> Column:
        (ax, ay), (bx, by), n = xy(q.getField("a")), xy(q.getField("b")), q.getField("len")
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - q.getField("from")) / n))).otherwise(0.0)
        return point(ax + (bx - ax) * t, ay + (by - ay) * t)

    return let(seg, on)


def projected(m: Column, p: Column) -> Column:
    """struct(d, s): distance from the point to a measured line and the position of its nearest point, the first of equal ones."""
    px, py = xy(p)

    def near(q: Column) -> Column:
        (ax, ay), (bx, by), n = xy(q.getField("a")), xy(q.getField("b")), q.getField("len")
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / (n * n)))).otherwise(0.0)
        return let(t, lambda u: F.struct(F.hypot(px - (ax + (bx - ax) * u), py - (ay + (by - ay) * u)).alias("d"), (q.getField("from") + u * n).alias("s")))

    return F.array_min(F.transform(m, near))


def samples(n: Column, step: float) -> Column:
    """0, step, 2 step, ... below n, and n itself."""
    count = F.greatest(F.ceil(n / step), F.lit(1)).cast("int")
    return F.array_append(F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * F.lit(float(step))), n)


def midpoint(g: Column) -> Column:
    return let(measured(g), lambda m: along(m, (F.element_at(m, -1).getField("from") + F.element_at(m, -1).getField("len")) / 2))


def sampled_distance(g: Column, other: Column, step: float) -> Column:
    """Mean distance to `other` of samples of `g`, its end included."""

    def mean(m: Column) -> Column:
        end = F.element_at(m, -1)
        return let(samples(end.getField("from") + end.getField("len"), step), lambda s: total(F.transform(F.transform(s, lambda v: along(m, v)), lambda p: projected(other, p).getField("d"))) / F.size(s))

    return let(measured(g), mean)


def signed_area(ring: Column) -> Column:
    """Shoelace area of a ring that need not be closed, positive if it runs counter-clockwise."""
    n = F.size(ring)

    def cross(p: Column, i: Column) -> Column:
        (ax, ay), (bx, by) = xy(p), xy(F.get(ring, (i + 1) % n))
        return ax * by - bx * ay

    return total(F.transform(ring, cross)) / 2


def centroid(ring: Column) -> Column:
    """G29."""
    n = F.size(ring)

    def part(k: str):
        def one(p: Column, i: Column) -> Column:
            q = F.get(ring, (i + 1) % n)
            (ax, ay), (bx, by) = xy(p), xy(q)
            return (p.getField(k) + q.getField(k)) * (ax * by - bx * ay)

        return total(F.transform(ring, one))

    return let(signed_area(ring) * 6, lambda a: F.when(a != 0, point(part("x") / a, part("y") / a)))


def contains(ring: Column, p: Column) -> Column:
    """Whether a point lies inside a ring, by the number of edges that a ray to the right crosses."""
    px, py = xy(p)
    n = F.size(ring)

    def crosses(q: Column, i: Column) -> Column:
        (ax, ay), (bx, by) = xy(q), xy(F.get(ring, (i + 1) % n))
        return F.when((ay > py) != (by > py), F.when(px < (bx - ax) * (py - ay) / (by - ay) + ax, 1).otherwise(0)).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda acc, v: acc + v) % 2 == 1


def bounds(g: Column) -> Column:
    """G35."""
    xs, ys = F.transform(g, lambda p: p.getField("x")), F.transform(g, lambda p: p.getField("y"))
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def undirected_key(g: Column) -> Column:
    """One key for a line and its reverse."""
    return F.least(F.to_json(g), F.to_json(F.reverse(g)))


def outward(g: Column, cx: float, cy: float) -> Column:
    """The line turned so that it leads away from the centre: its last vertex is not nearer than its first."""
    c = point(F.lit(cx), F.lit(cy))
    return F.when(distance(F.get(g, F.lit(0)), c) <= distance(F.element_at(g, -1), c), g).otherwise(F.reverse(g))


def snapped(g: Column, start: Column, end: Column) -> Column:
    """First and last vertex replaced."""
    return F.concat(F.array(start), F.slice(g, F.lit(2), F.greatest(F.size(g) - 2, F.lit(0))), F.array(end))


def chord_middles(m: Column, centre: Column, radius: float) -> Column:
    """Positions midway of the stretches of a measured line inside a circle, a stretch for each segment that meets it."""
    cx, cy = xy(centre)

    def hit(q: Column) -> Column:
        (ax, ay), (bx, by), n = xy(q.getField("a")), xy(q.getField("b")), q.getField("len")
        dx, dy, fx, fy = bx - ax, by - ay, ax - cx, ay - cy
        half = fx * dx + fy * dy
        disc = half * half - n * n * (fx * fx + fy * fy - radius * radius)
        root = F.sqrt(F.greatest(disc, F.lit(0.0)))
        t0, t1 = F.greatest(F.lit(0.0), (-half - root) / (n * n)), F.least(F.lit(1.0), (-half + root) / (n * n))
        return F.when((n > 0) & (disc > 0) & (t0 < t1), q.getField("from") + n * (t0 + t1) / 2)

    return F.filter(F.transform(m, hit), lambda s: s.isNotNull())


def clipped_length(g: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Length of the line inside an axis-parallel cell, each segment clipped to it."""

    def inside(s: Column) -> Column:
        (ax, ay), (bx, by) = xy(s.getField("a")), xy(s.getField("b"))

        def interval(a: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
            out = (a < lo) | (a > hi)
            t0 = F.when(d > 0, (lo - a) / d).when(d < 0, (hi - a) / d).otherwise(F.when(out, 2.0).otherwise(0.0))
            t1 = F.when(d > 0, (hi - a) / d).when(d < 0, (lo - a) / d).otherwise(F.when(out, -1.0).otherwise(1.0))
            return t0, t1

        (u0, u1), (v0, v1) = interval(ax, bx - ax, xmin, xmax), interval(ay, by - ay, ymin, ymax)
        share = F.least(F.lit(1.0), u1, v1) - F.greatest(F.lit(0.0), u0, v0)
        return F.greatest(F.lit(0.0), share) * distance(s.getField("a"), s.getField("b"))

    return total(F.transform(segments(g), inside))
