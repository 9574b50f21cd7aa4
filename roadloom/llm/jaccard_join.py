"""N-gram Jaccard join with prefix filters under several global token orders.

Two sets of similarity t or more must share a token among the first
|x| - ceil(t|x|) + 1 of each, under any one order of all tokens. One order here
puts tokens first that a fixed-size counting sketch calls rarer, level by
level; the other deals all tokens by a hash, but for the common ones, which
come last. Candidates must share a prefix token under every order. A posting
knows its place in the prefix: what two sets have in common cannot exceed what
is left of either from the first token they share, so a posting bounds the size
of its partners, and of two near copies with many words of their own no list
makes a candidate.

Groups of near copies do not become all pairs. Equal sets are one class from
the start. In two rounds each class is compared with the most central class of
its lists (the one whose bound is widest for its size; in a group of copies,
the text they were made of), and what that links is a component; then all
candidates that lie in different components are compared. A pair left out lies
in one component already, so no component is missed.

Every class carries a bitmap of 2048 bits in which each of its tokens flips
one. Two sets' intersection is at most half of what their sizes add up to
beyond the bits in which they differ, so most pairs below the threshold fall
without their sets being moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import balanced_labels, freed_shuffles, partitions, small_batches, written
from roadloom.llm.components import components
from roadloom.llm.word_hash import mix, set_chunks, shingle_sets

_U = np.uint64
ORDERS = 2
ROUNDS, PARTNERS = 2, 3
BITS = 2048
#: Counters of the sketch, as a power of two, one byte each: a fixed size, whatever the input.
MOST_COUNTERS = 25
#: Tokens of more than 2^COMMON - 1 documents come last under the order by hash.
COMMON = 7
#: Entries of a list that are compared with each other at a time; longer lists are cut in blocks, and pairs of blocks dealt out.
BLOCK = 2048
#: Postings that a task packs at a time, and rows of two ids (16 bytes) up to which they are broadcast.
PACKED, FEW = 1 << 18, 250_000


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64))


def _sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of `counts` numbers, modulo 2^64."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(x, dtype=_U)])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]


def signatures(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set of a run of sets."""
    return _sums(mix(flat, 51), counts), _sums(mix(flat, 52), counts)


def bitmap(x: np.ndarray) -> bytes:
    """BITS bits of which each element of the set flips one."""
    return np.packbits(np.bincount((mix(x, 53) >> _U(53)).astype(np.int64), minlength=BITS) & 1).tobytes()


def set_signatures(docs: DataFrame, width: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `carry`, n_shingles, s1, s2 of each row's whole text, and its bitmap."""
    kept = docs.select("doc_id", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, flat, counts in set_chunks(b.column(b.num_columns - 1).to_pylist(), width):
                s1, s2 = signatures(flat, counts)
                bits = [bitmap(x) for x in np.split(flat, np.cumsum(counts)[:-1])]
                own = [c.slice(first, len(counts)) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(counts.astype(np.int64)), _signed(s1), _signed(s2), pa.array(bits, pa.binary())], names=names)

    added = T.StructType.fromDDL("n_shingles long, s1 long, s2 long, bits binary")
    schema = T.StructType([*kept.schema, *added])
    names = schema.names
    return docs.select("doc_id", *carry, "text").mapInArrow(run, schema)


def count_sketch(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """One byte for each of 2^bits counters: the bit length of the number of shingles (once a row) that fall in it.

    A task counts up to 255 and stops there, which changes the order of tokens
    and no result. Tasks send their counters in slices, only those that are
    not zero, and a slice is summed in one place; what reaches the driver has
    a fixed size.
    """
    slices = 1 << min(6, bits)
    each = (1 << bits) // slices

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for b in batches:
            for _, flat, _ in set_chunks(b.column(0).to_pylist(), width):
                at, n = np.unique((mix(flat, 61) >> _U(64 - bits)).astype(np.int64), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 255)
        press = zstandard.ZstdCompressor(level=1)
        rows = []
        for s in range(slices):
            part = counts[s * each : (s + 1) * each]
            at = np.flatnonzero(part).astype(np.uint32)
            if len(at):
                rows.append((s, press.compress(np.diff(at, prepend=np.uint32(0)).astype(np.uint32).tobytes()), press.compress(part[at].tobytes())))
        if rows:
            s, a, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(a, pa.binary()), pa.array(c, pa.binary())], names=["slice", "at", "n"])

    def total(key: tuple, table: pa.Table) -> pa.Table:
        counts, un = np.zeros(each, np.uint32), zstandard.ZstdDecompressor()
        for a, c in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            counts[np.cumsum(np.frombuffer(un.decompress(a), np.uint32), dtype=np.int64)] += np.frombuffer(un.decompress(c), np.uint8)
        level = np.ceil(np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "level": pa.array([zstandard.ZstdCompressor().compress(level.tobytes())], pa.binary())})

    summed = docs.select("text").mapInArrow(partial, "slice int, at binary, n binary").groupBy("slice").applyInArrow(total, "slice int, level binary")
    with small_batches(docs.sparkSession), freed_shuffles(docs.sparkSession):
        rows = summed.collect()
    levels, un = np.zeros((slices, each), np.uint8), zstandard.ZstdDecompressor()
    for r in rows:
        levels[r["slice"]] = np.frombuffer(un.decompress(r["level"]), np.uint8)
    return levels.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bound(n: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """The largest size of a set that can be similar to one of size n if the first token they share is at place `at` of the latter."""
    return (100 + percent) * (n - at) // percent - n


def _others(v: np.ndarray, begins: np.ndarray, group: np.ndarray, best: np.ufunc, worst: int) -> np.ndarray:
    """The best value among the other entries of each one's group; groups begin at `begins`."""
    top = best.reduceat(v, begins)
    at = np.flatnonzero(v == top[group])
    own = at[np.searchsorted(group[at], np.arange(len(begins)))]  # one entry of each group that has it
    rest = v.copy()
    rest[own] = worst
    out = top[group]
    out[own] = best.reduceat(rest, begins)
    return out


def posting_lists(docs: DataFrame, width: int, percent: int, levels: np.ndarray, buckets: int) -> DataFrame:
    """order, token, node, n, most: the postings of prefix tokens under each order that another class can meet.

    `most` bounds the size of a partner. Rows are packed by bucket of the
    token before the shuffle, and equal entries of copies fall together.
    """
    bits = int(len(levels)).bit_length() - 1
    names = balanced_labels(docs.sparkSession, ORDERS * buckets)
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # its size is fixed by `bits`

    def packed_rows(held: list[tuple]) -> pa.RecordBatch:
        press, out = zstandard.ZstdCompressor(level=1), []
        nodes, counts = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        length = np.concatenate([h[2] for h in held])
        of = np.repeat(np.arange(len(nodes)), length)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        for k in range(ORDERS):
            token = mix(np.concatenate([h[3 + k] for h in held]), 80 + k)
            bucket = ((token >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            order = np.lexsort((of, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                part = order[cuts[i] : cuts[i + 1]]
                used, local = np.unique(of[part], return_inverse=True)
                narrow = [x.astype(np.uint16 if x.max() < 65536 else np.uint32) for x in (local, place[part])]
                blob = b"".join((token[part].tobytes(), *[x.tobytes() for x in narrow], nodes[used].tobytes(), counts[used].astype(np.uint32).tobytes()))
                out.append((names[k * buckets + i], k, len(part), len(used), narrow[1].itemsize, press.compress(blob)))
        cols = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bucket", "order", "n", "used", "wide", "packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, held, size = shared.value, [], 0
        for b in batches:
            for _, flat, counts in set_chunks(b.column(0).to_pylist(), width):
                nodes, ends = signatures(flat, counts)[0], np.cumsum(counts)
                rank = level[(mix(flat, 61) >> _U(64 - bits)).astype(np.int64)]
                orders = (rank.astype(_U) << _U(56) | mix(flat, 70) >> _U(8), (rank > COMMON).astype(_U) << _U(56) | mix(flat, 71) >> _U(8))
                _, once = np.unique(nodes, return_index=True)
                once = once[counts[once] > 0]
                if not len(once):
                    continue
                length = np.array([prefix_length(n, percent) for n in counts[once].tolist()])
                keys = []
                for by in orders:
                    own = []
                    for i, p in zip(once.tolist(), length.tolist(), strict=True):
                        lo, hi = ends[i] - counts[i], ends[i]
                        here = by[lo:hi]
                        if p < hi - lo:
                            first = np.argpartition(here, p - 1)[:p]
                            first = first[np.argsort(here[first])]
                        else:
                            first = np.argsort(here)
                        own.append(flat[lo + first])
                    keys.append(np.concatenate(own))
                held.append((nodes[once], counts[once], length, *keys))
                size += len(keys[0])
                if size >= PACKED:
                    yield packed_rows(held)
                    held, size = [], 0
        if held:
            yield packed_rows(held)

    def lists(key: tuple, table: pa.Table) -> pa.Table:
        un, tokens, nodes, sizes, places = zstandard.ZstdDecompressor(), [], [], [], []
        for n, used, wide, packed in zip(*[table.column(c).to_pylist() for c in ("n", "used", "wide", "packed")], strict=True):
            raw = un.decompress(packed)
            kind = np.dtype(np.uint16 if used <= 65536 else np.uint32)
            local = np.frombuffer(raw, kind, n, 8 * n).astype(np.int64)
            at = (8 + kind.itemsize) * n
            tokens.append(np.frombuffer(raw, _U, n))
            places.append(np.frombuffer(raw, np.uint16 if wide == 2 else np.uint32, n, at).astype(np.uint32))
            at += wide * n
            nodes.append(np.frombuffer(raw, _U, used, at)[local])
            sizes.append(np.frombuffer(raw, np.uint32, used, at + 8 * used)[local])
        token, node, size, place = map(np.concatenate, (tokens, nodes, sizes, places))
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        order, token, node = order[new], token[new], node[new]
        size = size[order].astype(np.int64)
        most = bound(size, place[order].astype(np.int64), percent)
        for _ in range(3):  # a list without the entries that meet nobody may have more of them
            if not len(token):
                break
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            begins, group = np.flatnonzero(new), np.cumsum(new) - 1
            keep = (_others(size, begins, group, np.minimum, 1 << 62) <= most) & (_others(most, begins, group, np.maximum, -1) >= size)
            token, node, size, most = token[keep], node[keep], size[keep], most[keep]
        m, k = len(token), table.column("order")[0].as_py()
        return pa.table({"order": pa.array(np.full(m, k, np.int32)), "token": _signed(token), "node": _signed(node), "n": pa.array(size), "most": pa.array(most)})

    packed = docs.select("text").mapInArrow(pack, "bucket int, order int, n long, used long, wide int, packed binary")
    return packed.groupBy("bucket").applyInArrow(lists, "order int, token long, node long, n long, most long")


def mixed_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """`lists` with their classes' labels, as far as they hold more than one component."""
    labelled = lists.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("order", "token").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("order", "token")
    return written(labelled.join(mixed, ["order", "token"]).select("order", "token", "node", "n", "most", "label"), "mixed-lists")


def _with_head(lists: DataFrame) -> DataFrame:
    """`lists` with each list's most central class: the one whose bound is widest for its size."""
    by = F.col("most") / F.col("n")
    of = [F.max_by(c, by).alias(f"h_{c}") for c in ("node", "n", "most", "label")]
    return lists.join(lists.groupBy("order", "token").agg(*of), ["order", "token"])


def central_partners(mixed: DataFrame, percent: int, tried: DataFrame | None) -> DataFrame:
    """(a, b), a < b: for each class the PARTNERS classes of other components that it meets most often as the most central of its lists, under every order, and has not been compared with.

    Where something has been compared, the most central class of another
    component than the list's first one is asked as well.
    """
    first = _with_head(mixed)
    heads = [first]
    if tried is not None:
        rest = first.where("label <> h_label").select(mixed.columns)
        heads.append(_with_head(rest))
    met = None
    for x in heads:
        fit = x.where("label <> h_label AND n <= h_most AND h_n <= most").select(F.col("node").alias("me"), F.col("h_node").alias("other"), "order")
        met = fit if met is None else met.unionByName(fit)
    met = met.groupBy("me", "other").agg(F.count("*").alias("times"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("order"))).alias("orders")).where(F.col("orders") == (1 << ORDERS) - 1)
    met = met.select("me", "times", F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"))
    if tried is not None:
        met = met.join(tried, ["a", "b"], "left_anti")
    place = F.row_number().over(Window.partitionBy("me").orderBy(F.desc("times"), "a", "b"))
    return met.withColumn("_place", place).where(F.col("_place") <= PARTNERS).select("a", "b").distinct()


def candidates_between(mixed: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: all pairs of classes in different components that share a prefix token under every order and fit each other's bounds.

    A list tells each of its classes those of components of smaller labels as
    one packed row, so of a pair the same one is told under every order; its
    rows then meet, and a pair is made once however many tokens it shares. A
    list of more than `block` classes is cut in blocks by a hash of the class,
    and each pair of blocks is dealt out by itself.
    """
    spark = mixed.sparkSession
    names = balanced_labels(spark, 6 * partitions(spark))
    slot = lambda *c: F.element_at(F.array(*[F.lit(x) for x in names]), F.pmod(F.xxhash64(*c), F.lit(len(names))).cast("int") + 1)

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        token, node, n, most, label, k, own, other = (table.column(c).to_numpy() for c in ("token", "node", "n", "most", "label", "order", "own", "other"))
        low, high = np.minimum(own, other), np.maximum(own, other)
        order = np.lexsort((node, ~label, high, low, token, k))  # by falling label
        token, node, n, most, label, k, own, low, high = (x[order] for x in (token, node, n, most, label, k, own, low, high))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (k[1:] != k[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        begins = np.flatnonzero(new)
        rows = []
        for lo, hi in zip(begins.tolist(), np.append(begins[1:], len(token)).tolist(), strict=True):
            ends = np.append(np.flatnonzero(label[lo + 1 : hi] != label[lo : hi - 1]) + lo + 1, hi).tolist()
            start, across = lo, low[lo] != high[lo]
            for e in ends[:-1]:
                for i in range(start, e):
                    fit = (n[e:hi] <= most[i]) & (most[e:hi] >= n[i])
                    if across:
                        fit &= own[e:hi] != own[i]
                    if fit.any():
                        rows.append((int(node[i]), int(k[lo]), node[e:hi][fit].tobytes()))
                start = e
        a, o, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"me": pa.array(a, pa.int64()), "order": pa.array(o, pa.int32()), "others": pa.array(b, pa.binary())})

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        me, orders, others = table.column("me").to_numpy(), table.column("order").to_numpy(), table.column("others").to_pylist()
        out_a, out_b = [], []
        by = np.argsort(me, kind="stable")
        cuts = np.flatnonzero(np.diff(me[by], prepend=~me[by][:1]))
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(by)).tolist(), strict=True):
            told = [[others[i] for i in by[lo:hi] if orders[i] == k] for k in range(ORDERS)]
            if all(told):
                sets = [np.unique(np.frombuffer(b"".join(t), np.int64)) for t in told]
                both = sets[0]
                for x in sets[1:]:
                    both = np.intersect1d(both, x, assume_unique=True)
                out_a.append(np.full(len(both), me[by[lo]]))
                out_b.append(both)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    sizes = mixed.groupBy("order", "token").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    cut = mixed.join(sizes, ["order", "token"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = cut.select("order", "token", "node", "n", "most", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = paired.withColumn("slot", slot("order", "token", F.least("own", "other"), F.greatest("own", "other")))
    asked = dealt.groupBy("slot").applyInArrow(tell, "me long, order int, others binary")
    return asked.withColumn("slot", slot("me")).groupBy("slot").applyInArrow(meet, "a long, b long").distinct()


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose bitmaps allow an intersection of `percent` hundredths of the union; it never drops a similar pair."""
    of = lambda c: classes.select(F.col("s1").alias(c), F.col("n_shingles").alias(f"_n{c}"), F.col("bits").alias(f"_{c}"))

    def allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n = t.column(2).to_numpy() + t.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint64).reshape(len(n), -1) for i in (4, 5))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            most = (n - apart) // 2
            mask = pa.array(100 * most >= percent * (n - most))
            yield pa.RecordBatch.from_arrays([t.column(0).filter(mask), t.column(1).filter(mask)], names=["a", "b"])

    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "_na", "_nb", "_a", "_b").mapInArrow(allow, "a long, b long")


def listed_sets(lists: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(node, items) of all classes that have a posting in `lists`, once for each row of a repeated one; their texts are read once."""
    nodes = lists.select(F.col("node").alias("s1")).distinct()
    named = written(nodes.join(classes.select("s1", F.col("rep").alias("doc_id")), "s1"), "named")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(1).to_numpy()
            for first, flat, counts in set_chunks(b.column(0).to_pylist(), width):
                own = signatures(flat, counts)[0].view(np.int64)
                ok = own == wanted[first : first + len(own)]  # a doc_id may stand for several texts
                items = [x.tobytes() for x, y in zip(np.split(flat, np.cumsum(counts)[:-1]), ok, strict=True) if y]
                yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(items, pa.binary())], names=["node", "items"])

    # a row has 16 bytes; with more of them texts and names meet by a shuffle
    sent = F.broadcast(named) if named.count() <= FEW else named
    texts = docs.select("doc_id", "text").join(sent, "doc_id").select("text", "s1")
    return written(texts.mapInArrow(sets, "node long, items binary"), "sets")


def verified(pairs: DataFrame, items: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs of classes whose sets have an intersection of `percent` hundredths of their union or more."""
    pairs = written(possible(pairs, classes, percent), "pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for i in range(t.num_rows):  # views of the batch, not copies
                x, y = (np.frombuffer(t.column(k)[i].as_buffer(), _U) for k in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(mask), t.column(1).filter(mask)], names=["a", "b"])

    # few pairs go to the sets, which stay where they are; with many, sets and pairs meet by shuffles
    sent = F.broadcast if pairs.count() <= FEW else lambda x: x
    ours = items.join(sent(pairs.select(F.col("b").alias("node")).distinct()), "node", "left_semi")
    one = items.select(F.col("node").alias("a"), F.col("items").alias("_x")).join(sent(pairs), "a")
    two = one.join(ours.select(F.col("node").alias("b"), F.col("items").alias("_y")), "b")
    return written(two.select("a", "b", "_x", "_y").mapInArrow(compare, "a long, b long"), "verified")


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, the columns `carry`, n_shingles, component_id, component.

    A row's set is that of its distinct `width`-word shingles, A-Z
    lower-cased, words cut at ASCII white space; with fewer words the whole
    sequence is one; without words the set is empty and links with nothing.
    Rows link when their sets' intersection has `percent` hundredths of the
    union or more; component_id is the least doc_id that links reach, and
    component a number that tells components apart where several rows have
    one doc_id (null for empty sets). Null texts are empty. A row without
    doc_id cannot be named: it has no component (null) and takes no part.
    Repeated rows each stand in the result. Other columns are ignored; an
    empty table gives none.
    """
    spark = docs.sparkSession
    signed = written(set_signatures(docs, width, carry), "signatures")
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(named.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits")), "classes")
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return signed.select("doc_id", *carry, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    source = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    bits = min(MOST_COUNTERS, max(12, math.ceil(math.log2(total / 4))))
    buckets = max(partitions(spark), total // 4_000_000)
    lists = written(posting_lists(source, width, percent, count_sketch(source, width, bits), buckets), "lists")
    items = listed_sets(lists, source, classes, width)
    mixed, tried, links, labels = lists.withColumn("label", F.col("node")), None, None, None
    for k in range(ROUNDS + 1):
        # in the last round all that is left is compared
        asked = central_partners(mixed, percent, tried) if k < ROUNDS else candidates_between(mixed, percent)
        asked = written(asked, "asked")
        found = verified(asked, items, classes, percent)
        links = found if links is None else links.unionByName(found)
        if k == 0 or found.limit(1).count():
            labels = components(links)
        if k < ROUNDS:
            tried = asked if tried is None else tried.unionByName(asked)
            mixed = mixed_lists(mixed, labels)
            if not mixed.limit(1).count():
                break
    grouped = classes.join(labels, classes.s1 == labels.node, "left").withColumn("label", F.coalesce("label", "s1"))
    least = written(grouped.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    of_class = written(grouped.join(least, "label").select("s1", "s2", F.col("n_shingles").alias("_n"), "component_id", "label"), "of-class")
    same = (signed.s1 == of_class.s1) & (signed.s2 == of_class.s2) & (signed.n_shingles == of_class._n)
    joined = signed.join(of_class, same, "left")
    named_here = signed.doc_id.isNotNull()
    own = F.when(signed.n_shingles == 0, signed.doc_id).otherwise(F.col("component_id"))
    return joined.select(signed.doc_id, *[signed[c] for c in carry], signed.n_shingles, F.when(named_here, own).alias("component_id"), F.when(named_here, F.col("label")).alias("component"))
