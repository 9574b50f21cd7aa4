"""Token-id files: blocks of ids transposed into byte or bit planes, each plane compressed with zstandard, and a chunk index.

A file is MAGIC, the chunks' planes one after the other, the index (a
compressed JSON head and raw arrays) and its length with MAGIC again. The
index has each chunk's offset, number of ids and plane lengths, and each
document's id, start and number of ids, so one document can be read alone.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import new_folder, partitions
from roadloom.llm.text_pieces import PieceCoder

MAGIC = b"BPLANES1"
BLOCK = 1 << 16


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The block's 4 byte planes, or 32 bit planes, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    return [np.packbits(raw[:, k] >> j & 1).tobytes() for k in range(4) for j in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        if kind == "byte":
            raw[:, k] = np.frombuffer(p, np.uint8)
        else:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    return raw.reshape(-1).view("<u4")


class TokenFileWriter:
    """Writes documents' ids one after the other; keeps one block and the index in memory."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 1):
        self.out, self.kind, self.block, self.press = out, kind, block, zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.chunks: list[list] = []
        self.n_docs, self.docs = 0, []  # (ids, which are null, lengths) of runs of documents
        self.at = out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents whose ids lie one after the other in `ids`."""
        self.docs.append((np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), lengths.astype("<i8")))
        self.n_docs += len(doc_ids)
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            all_ids = np.concatenate(self.held)
            cut = len(all_ids) // self.block * self.block
            for i in range(0, cut, self.block):
                self._chunk(all_ids[i : i + self.block])
            self.held, self.n_held = [all_ids[cut:].copy()], len(all_ids) - cut

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.press.compress(p) for p in to_planes(ids, self.kind)]
        self.chunks.append([self.at, len(ids), *map(len, planes)])
        self.at += self.out.write(b"".join(planes))

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        doc_ids, null, lengths = (np.concatenate(c) for c in zip(*self.docs, strict=True)) if self.docs else (np.zeros(0, "<i8"), np.zeros(0, np.uint8), np.zeros(0, "<i8"))
        arrays = [np.array(self.chunks, "<i8").reshape(len(self.chunks), len(self.chunks[0]) if self.chunks else 0), doc_ids, lengths, null]
        head = json.dumps({"kind": self.kind, "total": self.total, "n_chunks": len(self.chunks), "n_docs": self.n_docs, "width": arrays[0].shape[1] if self.chunks else 0}).encode()
        index = self.press.compress(struct.pack("<I", len(head)) + head + b"".join(a.tobytes() for a in arrays))
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


def read_index(f) -> dict:
    """The index of an open token file, and an array of its documents' ids, starts and lengths."""
    size = f.seek(0, 2)
    f.seek(size - 16)
    tail = f.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a token file, or one that was cut short")
    (n,) = struct.unpack("<Q", tail[:8])
    f.seek(size - 16 - n)
    raw = zstandard.ZstdDecompressor().decompress(f.read(n))
    (k,) = struct.unpack("<I", raw[:4])
    x = json.loads(raw[4 : 4 + k])
    at, m = 4 + k, x["n_docs"]
    x["chunks"] = np.frombuffer(raw, "<i8", x["n_chunks"] * x["width"], at).reshape(x["n_chunks"], x["width"])
    at += x["chunks"].nbytes
    x["doc_ids"], x["lengths"] = np.frombuffer(raw, "<i8", m, at), np.frombuffer(raw, "<i8", m, at + 8 * m)
    x["null"] = np.frombuffer(raw, np.uint8, m, at + 16 * m)
    x["starts"] = np.cumsum(x["lengths"]) - x["lengths"]
    return x


def read_chunk(f, index: dict, i: int) -> np.ndarray:
    at, n, *lengths = (int(v) for v in index["chunks"][i])
    f.seek(at)
    raw, unpress, planes, done = f.read(sum(lengths)), zstandard.ZstdDecompressor(), [], 0
    for k in lengths:
        planes.append(unpress.decompress(raw[done : done + k]))
        done += k
    return from_planes(planes, n, index["kind"])


def read_documents(f) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of each document, holding no more than a document and a chunk."""
    x = read_index(f)
    held, begin, nxt = np.empty(0, "<u4"), 0, 0
    for doc_id, start, n, null in zip(x["doc_ids"].tolist(), x["starts"].tolist(), x["lengths"].tolist(), x["null"].tolist(), strict=True):
        parts, have = [held[start - begin :]], begin + len(held) - start
        while have < n:
            parts.append(read_chunk(f, x, nxt))
            have += len(parts[-1])
            nxt += 1
        held, begin = np.concatenate(parts) if len(parts) > 1 else parts[0], start
        yield None if null else doc_id, start, held[:n]


def write_token_files(docs: DataFrame, encoder: Callable, end_id: int | None = 0, kind: str = "byte", folder: str | None = None, file_tokens: int = 1 << 28, file_docs: int = 1 << 20) -> DataFrame:
    """Write the ids of `docs` (doc_id, text) in ascending doc_id order as token files in a shared folder.

    Returns the manifest, itself a written table: part, file, path, n_docs,
    n_tokens. Parts are ranges of doc_id in ascending order (null first), so
    their ids follow each other; a part is cut into files of about
    `file_tokens` ids and `file_docs` documents, which bounds the index that a
    task holds. `encoder` is called once per task and gives an object with
    column(texts), which yields (index of the first, ids, number of each) of
    runs of texts; `end_id` is appended to each document. Null and empty texts
    have just the end id. Equal doc_ids keep all their rows, ordered by text;
    other columns of `docs` are ignored.

    Each attempt of a task writes files of its own names, and the manifest
    names those of committed tasks, so a lost executor leaves an orphan at
    most, never a wrong or half-written part.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    dealt = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, out, path, done = encoder(), None, None, "", 0
        part = TaskContext.get().partitionId()
        fs, top = FileSystem.from_uri(folder)

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"part": [part], "file": [done], "path": [path], "n_docs": [writer.n_docs], "n_tokens": [writer.total]})

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, ids, counts in encode.column(b.column(1)):
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    name = f"part-{part:06d}-{done:06d}-{uuid.uuid4().hex}.planes"
                    path, out = f"{folder}/{name}", fs.open_output_stream(f"{top}/{name}")
                    writer = TokenFileWriter(out, kind)
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                writer.add(doc_ids[first : first + len(counts)], ids, counts)
                if writer.total >= file_tokens or writer.n_docs >= file_docs:
                    yield closed()
                    writer, done = None, done + 1
        if writer is not None:
            yield closed()

    manifest = f"{folder}-manifest"
    dealt.mapInArrow(run, "part long, file long, path string, n_docs long, n_tokens long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document read back from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row a file, so its running sum is taken on the driver.
    """
    spark = manifest.sparkSession
    files = manifest.select("path", "n_tokens").orderBy("part", "file").collect()
    bases, base = [], 0
    for r in files:
        bases.append((r["path"], base))
        base += r["n_tokens"]
    listed = spark.createDataFrame(bases, "path string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = FileSystem.from_uri(path)
                with fs.open_input_file(at) as f:
                    rows: list[tuple] = []
                    for doc_id, start, ids in read_documents(f):
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return listed.repartition(max(1, len(bases))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


class LibraryEncoder:
    """Encodes as encode(text, add_special_tokens=False) of a byte-level BPE file of the tokenizers library does.

    The library's model gets each match of its byte-level pre-tokenizer's
    pattern in its own byte alphabet, once as long as the piece is kept. A
    text that holds the string of an added token goes to encode() as a whole.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.alphabet = {b: b if b in plain else next(other) for b in range(256)}
        self.model = self.whole.model
        self.coder = PieceCoder(self._piece, regex.compile(pattern).findall)

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]

    def column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index of the first, ids, number of each) of runs of texts."""
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        begin = 0
        for i in [*np.flatnonzero(special).tolist(), len(texts)]:
            for first, ids, counts in self.coder.column(texts.slice(begin, i - begin)):
                yield begin + first, ids, counts
            if i < len(texts):
                ids = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
                yield i, ids, np.array([len(ids)])
            begin = i + 1

    def __call__(self, text: str | None) -> np.ndarray:
        return np.concatenate([ids for _, ids, _ in self.column(pa.array([text], pa.string()))])


_encoders: dict[tuple[str, str], LibraryEncoder] = {}


def library_encoder(path: str, pattern: str) -> Callable[[], LibraryEncoder]:
    """A maker of this worker's encoder; workers are reused, so it is built once in each."""

    def make() -> LibraryEncoder:
        if (path, pattern) not in _encoders:
            _encoders[path, pattern] = LibraryEncoder(path, pattern)
        return _encoders[path, pattern]

    return make
