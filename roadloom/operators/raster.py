"""Centerlines from road surfaces: occupancy pixels, thinning, skeleton graph and chains.

Pixels within the buffer of a segment come from arithmetic on the segment's
box, tile by tile. Thinning is local: a pixel's fate in n passes hangs on the
pixels at most 2n away, so each tile is thinned with a halo of that many
pixels by itself, in numpy, and its halo is cut off again. Rounds of n passes,
each written, exchange the halos until no pixel goes any more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as G
from roadloom.operators.graph import components
from roadloom.sources.store import stored


def surface_pixels(lines: DataFrame, geom: str, buffer: float, pixel: float) -> DataFrame:
    """(px, py) of pixels whose centre is at most `buffer` from a line."""
    seg = lines.select(F.explode(G.segments(F.col(geom))).alias("s")).select(F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    span = lambda k: F.sequence(F.floor((F.least(f"a.{k}", f"b.{k}") - buffer) / pixel), F.floor((F.greatest(f"a.{k}", f"b.{k}") + buffer) / pixel))
    at = seg.select("a", "b", F.explode(span("x")).alias("px")).select("a", "b", "px", F.explode(span("y")).alias("py"))
    cx, cy = (F.col("px") + 0.5) * pixel, (F.col("py") + 0.5) * pixel
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((cx - F.col("a.x")) * dx + (cy - F.col("a.y")) * dy) / n))).otherwise(0.0)
    return at.where(F.hypot(cx - (F.col("a.x") + dx * t), cy - (F.col("a.y") + dy * t)) <= buffer).select("px", "py").distinct()


def thin(image: np.ndarray, passes: int) -> np.ndarray:
    """Zhang and Suen's thinning: pixels go in two half passes by the pattern of their eight neighbours."""
    img = np.pad(image.astype(bool), 1)
    for _ in range(passes):
        before = img.copy()
        for half in (0, 1):
            n = [np.roll(img, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            around = sum(x.astype(np.int8) for x in n)
            turns = sum((~n[i] & n[(i + 1) % 8]).astype(np.int8) for i in range(8))
            open_sides = ~(n[0] & n[2] & n[4]) & ~(n[2] & n[4] & n[6]) if half == 0 else ~(n[0] & n[2] & n[6]) & ~(n[0] & n[4] & n[6])
            img = img & ~((around >= 2) & (around <= 6) & (turns == 1) & open_sides)
            img[0] = img[-1] = img[:, 0] = img[:, -1] = False
        if (img == before).all():
            break
    return img[1:-1, 1:-1]


def skeleton_pixels(pixels: DataFrame, passes: int = 24, tile: int = 256) -> DataFrame:
    """Pixels that thinning leaves, in rounds of `passes` until none changes."""
    left, n = pixels, -1
    while True:
        left = stored(thinned(left, passes, tile))
        before, n = n, left.count()
        if n == before:
            return left


def thinned(pixels: DataFrame, passes: int, tile: int) -> DataFrame:
    """Pixels that `passes` passes of thinning leave. A tile is a group of a size that the pixel grid fixes."""
    halo = 2 * passes
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    dealt = pixels.select("px", "py", F.explode(reach("px")).alias("tx")).select("px", "py", "tx", F.explode(reach("py")).alias("ty"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tx, ty = (k.as_py() for k in key)
        x, y = table.column("px").to_numpy() - tx * tile + halo, table.column("py").to_numpy() - ty * tile + halo
        image = np.zeros((tile + 2 * halo, tile + 2 * halo), bool)
        image[np.clip(x, 0, image.shape[0] - 1), np.clip(y, 0, image.shape[1] - 1)] = True
        kept = thin(image, passes)[halo : halo + tile, halo : halo + tile]
        i, j = np.nonzero(kept)
        return pa.table({"px": pa.array(i + tx * tile, pa.int64()), "py": pa.array(j + ty * tile, pa.int64())})

    return dealt.groupBy("tx", "ty").applyInArrow(run, "px long, py long")


def pixel_links(pixels: DataFrame) -> DataFrame:
    """Unit segments between 8-neighbours, each once, by four equi-joins on shifted pixels."""
    out = None
    for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
        shifted = pixels.select((F.col("px") - dx).alias("px"), (F.col("py") - dy).alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy"))
        part = pixels.join(shifted, ["px", "py"])
        out = part if out is None else out.unionByName(part)
    return out


def chains(links: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, chain): links merged through nodes of degree 2 into chains that end at other nodes.

    Links that meet at a node of degree 2 are neighbours; chains are the
    components of those neighbours.
    """
    numbered = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct().withColumn("link", F.xxhash64("a", "b"))
    ends = numbered.select("link", F.explode(F.array("a", "b")).alias("node"))
    inner = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("link").alias("l"), F.max("link").alias("m")).where("n = 2 AND l <> m")
    c = components(inner, "l", "m", numbered.select(F.col("link").alias("node")))
    return numbered.join(c.select(F.col("node").alias("link"), F.col("component").alias("chain")), "link").select("a", "b", "chain")
