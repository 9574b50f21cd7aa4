"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of the benchmark's items. For the
patterns of one length, a shift table has for each block of words the least
distance from its place in a pattern to the pattern's end; the search looks
at the block that ends at its position and skips that far, or as far as a
block that no pattern has allows. Where the distance is 0, the bucket of that
suffix names the patterns to compare, first by their first block and then word
by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import written

#: A-Z lower-cased; every ASCII character that is no letter or digit separates words; other bytes are parts of words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


class WuManber:
    """Patterns of one length as rows of word numbers, and the items that each belongs to.

    A block is the numbers of two words (or one) in one integer. `shift` has
    the distance of every block of a pattern, `buckets` the rows from ... to
    of the patterns that end with a block.
    """

    def __init__(self, rows: np.ndarray, items: list[tuple[int, ...]], names: list[str]):
        self.m = rows.shape[1]
        self.b = min(2, self.m)
        self.far, self.names = self.m - self.b + 1, names
        block = lambda end: rows[:, end - 1] if self.b == 1 else rows[:, end - 2] << 32 | rows[:, end - 1]
        order = np.argsort(block(self.m), kind="stable")
        rows = rows[order]
        self.rows, self.items = [x.tobytes() for x in rows.astype(np.int32)], [items[i] for i in order.tolist()]
        suffix, first, many = np.unique(block(self.m), return_index=True, return_counts=True)
        self.buckets = dict(zip(suffix.tolist(), zip(first.tolist(), (first + many).tolist(), strict=True), strict=True))
        # nearest to the pattern's end last, so that the least distance stays
        self.shift: dict[int, int] = {}
        for end in range(self.b, self.m + 1):
            self.shift.update(dict.fromkeys(np.unique(block(end)).tolist(), self.m - end))

    def search(self, words: list[int], raw: bytes) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(position of the first word, items) of each occurrence, from left to right; `raw` is the words as 4-byte integers."""
        m, far, shift, n, two = self.m, self.far, self.shift.get, len(words), self.b == 2
        end = m
        while end <= n:
            key = words[end - 2] << 32 | words[end - 1] if two else words[end - 1]
            away = shift(key, far)
            if away:
                end += away
                continue
            start = end - m
            here = raw[4 * start : 4 * end]
            for i in range(*self.buckets[key]):
                if self.rows[i] == here:
                    yield start, self.items[i]
            end += 1


class Searchers:
    """A block of the benchmark: its words' numbers from 1 (0: no word of it), its items, and a searcher for each length of window."""

    def __init__(self, items: list[tuple], window: int):
        self.number: dict[bytes, int] = {}
        self.names = ["null" if i is None else str(i) for i, _ in items]
        by_length: dict[int, dict[bytes, set]] = {}
        for k, (_, text) in enumerate(items):
            words = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], np.int32)
            size, found = min(window, len(words)), by_length.setdefault(min(window, len(words)), {})
            for i in range(len(words) - size + 1 if size else 0):
                found.setdefault(words[i : i + size].tobytes(), set()).add(k)
        self.by_length = []
        for size, found in sorted(by_length.items()):
            if size:
                rows = np.frombuffer(b"".join(found), np.int32).reshape(-1, size).astype(np.int64)
                self.by_length.append(WuManber(rows, [tuple(sorted(x)) for x in found.values()], self.names))

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(number of words, spans of words hit, items) of a whole text."""
        get = self.number.get
        words, spans, found = [get(w, 0) for w in words_of(text)], [], set()
        if any(words):
            raw = np.array(words, np.int32).tobytes()
            for s in self.by_length:
                for start, items in s.search(words, raw):
                    spans.append((start, start + s.m))
                    found.update(items)
        return len(words), spans, {self.names[i] for i in found}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


ADDED = {"n_words": "long", "n_hit": "long", "hit_spans": "array<struct<start:long,end:long>>", "items": "array<string>"}


def _scan(docs: DataFrame, searchers: Searchers, text: str, carry: bool) -> DataFrame:
    """One pass over `docs`; with `carry`, hits of earlier passes (columns hit_spans, items) are merged in."""
    names = docs.columns
    own = [c for c in names if c not in ADDED]
    at = names.index(text)
    added = T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in ADDED.items()))
    shared = docs.sparkSession.sparkContext.broadcast(searchers)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            before = zip(batch.column(names.index("hit_spans")).to_pylist(), batch.column(names.index("items")).to_pylist(), strict=True) if carry else None
            rows = []
            for x in batch.column(at).to_pylist():
                n_words, spans, found = tables.search(x)
                if carry:
                    old_spans, old_items = next(before)
                    spans += [(y["start"], y["end"]) for y in old_spans]
                    found |= set(old_items)
                spans = _merged(spans)
                rows.append((n_words, sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], sorted(found)))
            cols = [pa.array([r[i] for r in rows], kinds[i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in own] + cols, names=own + list(ADDED))

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in own] + list(added)))


def mark_benchmark_words(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """`docs` with n_words, n_hit, hit_spans (word positions, end exclusive) and items found, sorted as strings.

    The benchmark is a stated query set, searched in blocks of about
    `block_bytes` of text, whose tables take some 70 times as much memory in
    the driver and in a worker: one block, one pass; more blocks, a pass each,
    whose hits are merged. An item is never cut, so one longer than a block
    is a block of its own size. Null
    and empty texts have no words and no hits; equal rows are each judged;
    items without words occur nowhere; columns of `docs` with the names that
    are added here are replaced. Empty tables on either side are fine.
    """
    items = benchmark.select(F.col(item_id), F.col(item_text).alias("_text")).distinct()
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    dealt = items.withColumn("_block", F.pmod(F.xxhash64(item_id, "_text"), F.lit(blocks)))
    state = docs.select(*[f"`{c}`" for c in docs.columns if c not in ADDED])
    for k in range(blocks):
        # at most about block_bytes of text reach the driver at once
        rows = [(r[0], r[1]) for r in dealt.where(F.col("_block") == k).select(item_id, "_text").collect()]
        state = _scan(state, Searchers(rows, window), text, carry=k > 0)
        if k < blocks - 1:
            state = written(state, "decontaminated")
    return state
