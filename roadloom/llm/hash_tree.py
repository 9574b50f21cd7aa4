"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

A key descends level by level: at the root every region draws an exponential
time from the key's hash, at a rate of the weight below it, and the least time
wins; then the racks of that region draw, then the shards of that rack. Only
the chosen branch is looked at. A changed weight changes the draws of that
shard, its rack and its region alone, so at each level keys move only into or
out of the subtree whose weight changed.

Shards that join a tree later are a generation of their own: at the root each
generation of a region draws by itself, and a key stays within the generation
that won. A key that a new generation does not win keeps all its draws, so new
shards take keys only into themselves, wherever in the tree they stand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    generation: int = 0


def even_tree(n: int, per_rack: int = 2, racks: int = 5) -> list[Leaf]:
    """n shards of equal weight: per_rack to a rack, `racks` racks to a region."""
    return [Leaf(i // (per_rack * racks), i // per_rack, i) for i in range(n)]


def grow(tree: list[Leaf], leaves: list[Leaf]) -> list[Leaf]:
    """The tree with shards that take keys only into themselves."""
    new = 1 + max((x.generation for x in tree), default=-1)
    return [*tree, *[Leaf(x.region, x.rack, x.shard, x.weight, new) for x in leaves]]


def levels(tree: list[Leaf]) -> list[tuple]:
    """(region, generation, weight, [(rack, weight, [(shard, weight)])]) of the shards that have a weight, in order."""
    ordered = sorted((x for x in tree if x.weight > 0), key=lambda x: (x.region, x.generation, x.rack, x.shard))
    total = lambda xs: sum(x.weight for x in xs)
    out = []
    for (region, generation), found in groupby(ordered, lambda x: (x.region, x.generation)):
        below = list(found)
        racks = [(rack, list(xs)) for rack, xs in groupby(below, lambda x: x.rack)]
        out.append((region, generation, total(below), [(rack, total(xs), [(x.shard, x.weight) for x in xs]) for rack, xs in racks]))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def descend(key: Column, tree: list[Leaf]) -> Column:
    """The shard of each key; null keys are a key of their own."""
    shard = lambda x: f"named_struct('n', {int(x[0])}, 'g', 0, 'weight', {float(x[1])!r}D)"
    rack = lambda x: f"named_struct('n', {int(x[0])}, 'g', 0, 'weight', {float(x[1])!r}D, 'below', array({', '.join(map(shard, x[2]))}))"
    region = lambda x: f"named_struct('n', {int(x[0])}, 'g', {int(x[1])}, 'weight', {float(x[2])!r}D, 'below', array({', '.join(map(rack, x[3]))}))"
    root = F.expr(f"array({', '.join(map(region, levels(tree)))})")

    def chosen(level: int, generation: Column, nodes: Column) -> Column:
        """The node of least time; its number breaks ties."""

        def draw(x: Column, i: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), generation + x.getField("g"), x.getField("n")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
            return F.struct((-F.log(u) / x.getField("weight")).alias("time"), i.alias("i"))

        return F.get(nodes, F.array_min(F.transform(nodes, draw)).getField("i"))

    none = F.lit(0)
    of_rack = lambda g: lambda r: chosen(2, g, r.getField("below")).getField("n")
    of_region = lambda r: let(chosen(1, r.getField("g"), r.getField("below")), of_rack(r.getField("g")))
    return let(chosen(0, none, root), of_region)


def shard_by_tree(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, key: str = "doc_id", text: str = "text", bucket_rows: int = 50_000) -> DataFrame:
    """`docs`' keys with shard, slot, size, text_crc32, law and, where a grown tree is given, grown_shard.

    size is the text's UTF-8 bytes plus 16; a null text has size 16 and, as
    the empty text, the checksum 0. The law is `key`: the key and the tree
    alone decide, so rows of one key share a shard. slot numbers a shard's
    rows from 0 without gaps, by bucket of the key and key; repeated rows get
    slots of their own, and a null key is numbered like any other. Shards are
    numbered in parts of about `bucket_rows` rows each, cut by a hash of key
    and checksum, and offset by the parts' counts, so no shard is sorted as a
    whole in one task; rows alike in key, checksum and size alone stay
    together. An empty table stays empty; other columns of `docs` are left
    out, and a key column must not be called like a column of the result.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    k = F.col(key)
    crc = F.crc32(raw.cast("binary"))
    buckets = max(16, -(-docs.count() // (bucket_rows * max(1, len(tree)))))
    bucket = F.pmod(F.xxhash64(k, crc, F.lit("slot")), F.lit(buckets)).cast("int")
    placed = docs.select(
        k,
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        crc.alias("text_crc32"),
        descend(k, tree).alias("shard"),
        (descend(k, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        bucket.alias("_bucket"),
    )
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(key, "text_crc32", "size")))
    # a row for each bucket_rows rows of input: the planner chooses how to join it
    out = ranked.join(offsets, ["shard", "_bucket"])
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_rank") - 1).alias("slot"), "grown_shard")
