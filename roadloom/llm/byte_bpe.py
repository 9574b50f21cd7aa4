"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each leaf of the tree holds the rank of the pair that begins at its byte
position; the root gives the leftmost pair of least rank. A merge changes the
leaves of the merged token, of its live left neighbour and of the token that
it swallowed: three point updates of logarithmic cost, so a piece of n bytes
takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.text_pieces import PieceCoder

_NONE = 1 << 62


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: repeatedly merge the leftmost adjacent pair of least rank, found at the tree's root."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    size, bits = 1, n.bit_length()
    while size < n - 1:
        size *= 2
    mask, get = (1 << bits) - 1, ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << bits | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # where the token that begins here ends
    before = list(range(-1, n))  # where the token that ends here begins; -1: none
    while (top := tree[1]) != _NONE:
        at = top & mask
        middle = after[at]
        end = after[middle]
        after[at] = end
        before[end] = at
        left = before[at]
        a = b = size + at
        if end < n:
            r = get(piece[at : after[end]])
            tree[a] = _NONE if r is None else r << bits | at
        else:
            tree[a] = _NONE
        if middle < n - 1:
            b = size + middle
            tree[b] = _NONE
        c = a
        if left >= 0:
            r = get(piece[left:end])
            c = size + left
            tree[c] = _NONE if r is None else r << bits | left
        # the three paths to the root, level by level: they soon meet
        while a > 1:
            a >>= 1
            b >>= 1
            c >>= 1
            x, y = tree[2 * a], tree[2 * a + 1]
            tree[a] = x if x < y else y
            if b != a:
                x, y = tree[2 * b], tree[2 * b + 1]
                tree[b] = x if x < y else y
            if c != a:
                x, y = tree[2 * c], tree[2 * c + 1]
                tree[c] = x if x < y else y
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class RankCodec:
    """Encodes and decodes by a file of ranks. Ids of pieces are kept, as words recur; what is kept is bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.coder = PieceCoder(lambda piece: merge_piece(piece.encode(), ranks), regex.compile(pattern).findall)
        lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        blob = bytearray(int(lengths.sum()))
        for token, i in ranks.items():
            blob[self.starts[i] : self.starts[i] + len(token)] = token
        self.blob = np.frombuffer(bytes(blob), np.uint8)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> RankCodec:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return cls(ranks, pattern)

    def column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index of the first, ids, number of each) of runs of whole texts; nulls are empty."""
        return self.coder.column(texts)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text as little-endian unsigned 32-bit integers; null is the empty text."""
        return np.concatenate([ids for _, ids, _ in self.column(pa.array([text], pa.string()))])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return gathered(ids, self.starts, self.lengths, self.blob)


def gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, blob: np.ndarray) -> bytes:
    """The blob's strings numbered `ids`, one after the other."""
    n = lengths[ids]
    ends = np.cumsum(n)
    if not len(ends):
        return b""
    at = np.repeat(starts[ids] - ends + n, n)
    at += np.arange(ends[-1])
    return blob[at].tobytes()


_codecs: dict[tuple[str, str], RankCodec] = {}


def codec(path: str, pattern: str) -> RankCodec:
    """This worker's codec for the file; workers are reused, so its tables are built once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = RankCodec.from_file(path, pattern)
        gc.freeze()
        gc.set_threshold(100_000)  # the tables hold no cycles; walking them again and again costs a fifth of the time
    return _codecs[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a column `ids` array<int> of each whole text's token ids.

    A null text gives the empty array, as the empty text does. Every row gives
    one row; repeated rows are encoded alike. A column of `docs` that is
    already called `ids` is replaced. An empty table stays empty.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != ids]
    out = docs.select(*kept, F.col(f"`{text}`").alias(ids))
    schema = out.schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            for first, found, counts in own.column(b.column(len(names) - 1)):
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view("<i4")))
                yield pa.RecordBatch.from_arrays([*[c.slice(first, len(counts)) for c in b.columns[:-1]], lists], names=names)

    from pyspark.sql import types as T

    returned = T.StructType([*schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return out.mapInArrow(run, returned)


def decode_ids(docs: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "bytes") -> DataFrame:
    """`docs` with a binary column of the bytes that each row's ids stand for; null ids give empty bytes."""
    from pyspark.sql import types as T

    kept = [F.col(f"`{c}`") for c in docs.columns if c != data]
    out = docs.select(*kept, F.col(f"`{ids}`").alias(data))
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            found = [own.decode(np.array(x or [], np.int64)) for x in b.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], names=names)

    return out.mapInArrow(run, T.StructType([*out.schema.fields[:-1], T.StructField(data, T.BinaryType())]))
