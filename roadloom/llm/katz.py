"""Language-model scoring: a Katz backoff bigram model with Good-Turing discounts and exactly normalised backoff weights.

P(w | h) = d(c(h,w)) c(h,w) / c(h) where the pair occurs in training, else
alpha(h) P(w), and P(w | h) = P(w) after a history that training has not.
P(w) is d(c(w)) c(w) / N, the rest of the mass going to one unknown word. d is
Turing's r*/r for counts up to 5; beyond, where counts of counts are sparse,
they are taken to fall as 1/(r(r+1)), for which r*/r = (r+1)/(r+2), and so
they are where Turing's value is not between 0 and 1. alpha(h) is the mass
that the discounts leave, over the unigram mass of the words not seen after h.

Nothing grows on one machine. Word counts lie in files by ranges of the words'
hashes. Each batch of documents sends its pairs to a grid of cells, by ranges
of the following word and of the history, so neither a frequent word nor a
frequent history meets in one place. A cell counts its pairs and answers each
batch with its documents' sums; as the discounts are known only afterwards,
it answers with numbers of pairs of each small count instead of their
logarithms. Histories' masses and the pairs not seen in training then meet by
range of the history for alpha(h), and all answers of a batch are added up.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import balanced_labels, new_folder, partitions
from roadloom.llm.word_hash import chunks, mix, word_hashes

_U = np.uint64
K = 5
END, START = (int(x) for x in mix(np.array([1, 2], _U), 999))
BATCH_TOKENS, CELL_TOKENS, SLICE_WORDS = 1_500_000, 3_000_000, 2_000_000
DOCS, HEADS, MASSES, UNSEEN, STATS = range(5)


def planes(x: np.ndarray) -> bytes:
    """A uint32 array's bytes, all lowest first, which compress well."""
    return np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 4-byte (in planes) or 8-byte numbers, compressed together."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<cQ", a.dtype.kind.encode() if a.dtype.itemsize == 8 else b"4", len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() if a.dtype.itemsize == 8 else planes(a) for a in arrays))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 9 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<cQ", raw, 4 + 9 * i)
        if kind == b"4":
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4").reshape(-1))
            at += 4 * size
        else:
            out.append(np.frombuffer(raw, {b"u": "<u8", b"f": "<f8", b"i": "<i8"}[kind], size, at))
            at += 8 * size
    return out


def beyond(r: np.ndarray) -> np.ndarray:
    """The discounted count r* of counts over K."""
    r = r.astype(np.float64)
    return r * (r + 1) / (r + 2)


def discounts(n: list[int]) -> np.ndarray:
    """d(r) of r = 0 to K from the numbers n[r] of types that occur r times, n[0] unused."""
    d = np.ones(K + 1)
    for r in range(1, K + 1):
        turing = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        d[r] = turing if 0 < turing < 1 else (r + 1) / (r + 2)
    return d


def starred(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.where(c > K, beyond(c), d[np.minimum(c, K)] * c)


def slice_of(x: np.ndarray, n: int) -> np.ndarray:
    """The part of n equal ranges of hashes that each lies in."""
    return ((x >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def tokens_of(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, token hashes with an end each, number of tokens of each) of runs of texts."""
    for first, held in chunks(texts):
        words, counts = word_hashes(held)
        out = np.full(len(words) + len(held), _U(END))
        ends = np.cumsum(counts + 1) - 1
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = words
        yield first, out, counts + 1


def count_words(docs: DataFrame, folder: str, pieces: int) -> list:
    """Files of sorted word hashes and training counts, one for each range of hashes; their manifest, a row a file."""
    labels = balanced_labels(docs.sparkSession, pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, _U), np.zeros(0, np.int64)
        pending, size, total = [], 0, 0

        def fold():
            nonlocal words, counts, pending, size
            new, n = np.unique(np.concatenate(pending), return_counts=True) if pending else (np.zeros(0, _U), np.zeros(0, np.int64))
            both, where = np.unique(np.concatenate([words, new]), return_inverse=True)
            words, counts = both, np.bincount(where, np.concatenate([counts, n]), len(both)).astype(np.int64)
            pending, size = [], 0

        def rows():
            fold()
            cuts = np.searchsorted(slice_of(words, pieces), np.arange(pieces + 1))
            out = [(labels[i], i, packed(words[a:b], counts[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["label", "piece", "packed"])

        for b in batches:
            texts = [t for t, held in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if not held]
            for _, x, _ in tokens_of(texts):
                pending.append(x)
                size += len(x)
                if size > BATCH_TOKENS:
                    fold()
                    if len(words) > SLICE_WORDS:  # no task holds more words than this
                        yield rows()
                        words, counts = words[:0], counts[:0]
        yield rows()

    def store(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in table.column("packed").to_pylist()]
        words, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        fs, top = FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        piece = table.column("piece")[0].as_py()
        name = f"words-{piece:06d}-{uuid.uuid4().hex}"  # each attempt has a file of its own; the manifest names one
        with fs.open_output_stream(f"{top}/{name}") as f:
            f.write(packed(words, counts))
        n = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[: K + 2]
        return pa.table({"piece": [piece], "path": [f"{folder}/{name}"], "tokens": [int(counts.sum())], "words": [len(words)], "rest": [float(beyond(counts[counts > K]).sum())], "n": [n.tolist()]}, schema=pa.schema([("piece", pa.int32()), ("path", pa.string()), ("tokens", pa.int64()), ("words", pa.int64()), ("rest", pa.float64()), ("n", pa.list_(pa.int64()))]))

    dealt = docs.mapInArrow(count, "label int, piece int, packed binary").groupBy("label")
    stored = dealt.applyInArrow(store, "piece int, path string, tokens long, words long, rest double, n array<long>")
    stored.write.parquet(f"{folder}-manifest")
    return docs.sparkSession.read.parquet(f"{folder}-manifest").orderBy("piece").collect()


def read_words(paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    words, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for p in paths:
        fs, at = FileSystem.from_uri(p)
        with fs.open_input_stream(at) as f:
            w, c = unpacked(f.read())
        words.append(w)
        counts.append(c)
    return np.concatenate(words), np.concatenate(counts)


def pair_batches(docs: DataFrame, slices: int, ranges: int, labels: list[int]) -> DataFrame:
    """label, kind, cell, batch, packed: each batch's pairs for each cell of the grid, and its documents."""

    def emit(batch: int, ids: list, held: list, toks: list, counts: list) -> pa.RecordBatch:
        t, n = np.concatenate(toks), np.concatenate(counts)
        doc = np.repeat(np.arange(len(n)), n)
        ends = np.cumsum(n)
        h = np.empty_like(t)
        h[1:] = t[:-1]
        h[ends - n] = _U(START)
        words, code = np.unique(np.concatenate([t, h]), return_inverse=True)
        w_code, h_code = code[: len(t)].astype(_U), code[len(t) :].astype(_U)
        toks.clear()
        # a pair's number, then the document's with it: neither has to fit a fixed number of bits
        pair, p_code = np.unique(w_code * _U(len(words)) + h_code, return_inverse=True)
        key, times = np.unique(doc.astype(_U) * _U(len(pair)) + p_code.astype(_U), return_counts=True)  # once a document
        del t, h, doc, code, w_code, h_code, p_code  # what is held at once is a few times BATCH_TOKENS numbers
        d, of = (key // _U(len(pair))).astype(np.int64), (key % _U(len(pair))).astype(np.int64)
        wc, hc = (pair // _U(len(words))).astype(np.int64)[of], (pair % _U(len(words))).astype(np.int64)[of]
        cell = slice_of(words, slices)[wc] * ranges + slice_of(mix(words, 7), ranges)[hc]
        order = np.argsort(cell, kind="stable")
        cuts = np.searchsorted(cell[order], np.arange(slices * ranges + 1))
        flag = times << 1 | ~np.array(held, bool)[d]
        rows = [(labels[batch % len(labels)], HEADS, 0, packed(np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint32), np.array(held, np.uint32), n.astype(np.uint32)))]
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[i] : cuts[i + 1]]
            codes = []
            for c in (wc[at], hc[at]):
                own, where, many = np.unique(c, return_inverse=True, return_counts=True)
                rank = np.argsort(-many, kind="stable")  # frequent words get small numbers
                place = np.empty(len(rank), np.uint32)
                place[rank] = np.arange(len(rank), dtype=np.uint32)
                codes += [words[own[rank]], place[where]]
            rows.append((labels[i], DOCS, i, packed(codes[0], codes[2], codes[1], codes[3], d[at].astype(np.uint32), flag[at].astype(np.uint32))))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array([batch] * len(rows), pa.int64()), pa.array(cols[3], pa.binary())], names=["label", "kind", "cell", "batch", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i = TaskContext.get().partitionId(), 0
        ids, held, toks, counts, size = [], [], [], [], 0
        for b in batches:
            own_ids, own_held = b.column(0).to_pylist(), b.column(2).to_pylist()
            for first, t, n in tokens_of(b.column(1).to_pylist()):
                if ids and (size + len(t) > BATCH_TOKENS or len(ids) + len(n) > 1 << 17):
                    yield emit(part << 24 | i, ids, held, toks, counts)
                    i += 1
                    ids, held, toks, counts, size = [], [], [], [], 0
                ids += own_ids[first : first + len(n)]
                held += own_held[first : first + len(n)]
                toks.append(t)
                counts.append(n)
                size += len(t)
        if ids:
            yield emit(part << 24 | i, ids, held, toks, counts)

    return docs.mapInArrow(run, "label int, kind int, cell int, batch long, packed binary")


def count_pairs(pairs: DataFrame, manifest: list, slices: int, ranges: int, model: dict, folder: str) -> DataFrame:
    """kind, part, packed, n: cells' answers to batches, documents, histories' masses, pairs not in training, and counts of counts."""
    pieces = len(manifest) and max(r["piece"] for r in manifest) + 1
    paths = [(r["piece"], r["path"]) for r in manifest]
    spread = model["pieces"]

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        cells: dict[int, list] = {}
        for kind, cell, batch, blob in zip(*[table.column(c).to_pylist() for c in ("kind", "cell", "batch", "packed")], strict=True):
            if kind == HEADS:
                out.append((HEADS, batch, blob, None))
            else:
                cells.setdefault(cell, []).append((batch, blob))
        for cell, payloads in cells.items():
            a, b = divmod(cell, ranges)
            lo, hi = a * spread // slices, -(-(a + 1) * spread // slices)  # the pieces that the slice's range meets
            words, counts = read_words([p for i, p in paths if lo <= i < hi])
            ws, hs, ds, fs, sizes = [], [], [], [], []
            for _, blob in payloads:
                w_words, h_words, w_at, h_at, d, f = unpacked(blob)
                ws.append(w_words[w_at])
                hs.append(h_words[h_at])
                ds.append(d)
                fs.append(f)
                sizes.append(len(d))
            w, h, f = np.concatenate(ws), np.concatenate(hs), np.concatenate(fs)
            del ws, hs
            times, train = (f >> 1).astype(np.int64), (f & 1).astype(bool)
            order = np.lexsort((h, w))
            new = np.ones(len(w), bool)
            new[1:] = (w[order][1:] != w[order][:-1]) | (h[order][1:] != h[order][:-1])
            first = np.flatnonzero(new)
            group = np.empty(len(w), np.int64)
            group[order] = np.cumsum(new) - 1
            c = np.add.reduceat(np.where(train, times, 0)[order], first)
            gw, gh = w[order][first], h[order][first]
            at = np.minimum(np.searchsorted(words, gw), max(0, len(words) - 1))
            cw = np.where(words[at] == gw, counts[at], 0) if len(words) else np.zeros(len(gw), np.int64)
            p1 = np.where(cw > 0, starred(cw, model["d"]) / max(1, model["tokens"]), model["unknown"])
            log = lambda x: np.log10(np.where(x > 0, x, 1))
            seen = c > 0
            fixed = np.where(seen, np.where(c > K, log(beyond(c)), 0.0), log(p1)) - np.where(gw == _U(END), 0.0, log(cw))
            base, known = np.log10(cw + 1.0), cw > 0
            small = np.where(seen & (c <= K), c, 0)
            lo = 0
            for (batch, _), d, n in zip(payloads, ds, sizes, strict=True):
                g, t = group[lo : lo + n], times[lo : lo + n]
                docs_here, where = np.unique(d, return_inverse=True)
                add = lambda v: np.bincount(where, v, len(docs_here))  # noqa: B023,E731
                r = small[g]
                cols = [add(t * (r == k)).astype(np.uint32) for k in range(1, K + 1)]
                out.append((DOCS, batch, packed(docs_here.astype(np.uint32), add(t * known[g]).astype(np.uint32), *cols, add(t * base[g]), add(t * fixed[g])), None))
                lost = ~seen[g]
                if lost.any():
                    own, code = np.unique(h[lo : lo + n][lost], return_inverse=True)
                    out.append((UNSEEN, b, packed(np.array([batch], np.int64), own, code.astype(np.uint32), d[lost], t[lost].astype(np.uint32)), None))
                lo += n
            if seen.any():
                by = np.argsort(gh[seen], kind="stable")
                hh, cc, pp = gh[seen][by], c[seen][by], p1[seen][by]
                start = np.flatnonzero(np.concatenate([[True], hh[1:] != hh[:-1]]))
                add = lambda v: np.add.reduceat(v, start)
                cols = [add((cc == k).astype(np.int64)).astype(np.uint32) for k in range(1, K + 1)]
                out.append((MASSES, b, packed(hh[start], *cols, add(cc), add(np.where(cc > K, beyond(cc), 0.0)), add(pp)), None))
                out.append((STATS, 0, None, np.bincount(np.minimum(cc, K + 2), minlength=K + 3)[: K + 2].tolist()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({"kind": pa.array(cols[0], pa.int32()), "part": pa.array(cols[1], pa.int64()), "packed": pa.array(cols[2], pa.binary()), "n": pa.array(cols[3], pa.list_(pa.int64()))})

    assert pieces <= spread
    pairs.groupBy("label").applyInArrow(answer, "kind int, part long, packed binary, n array<long>").write.partitionBy("kind").parquet(folder)
    return pairs.sparkSession.read.schema("part long, packed binary, n array<long>, kind int").parquet(folder)


def back_off(answers: DataFrame, d: np.ndarray, labels: list[int], folder: str) -> DataFrame:
    """Writes the model's histories (count, backoff weight) by range, and gives each batch the backed-off pairs' sums."""
    named = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("part").cast("int") + 1)

    def weigh(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpacked(x) for k, x in zip(table.column("kind").to_pylist(), table.column("packed").to_pylist(), strict=True) if k == MASSES]
        h, where = np.unique(np.concatenate([p[0] for p in parts] or [np.zeros(0, _U)]), return_inverse=True)
        total = lambda i: np.bincount(where, np.concatenate([p[i] for p in parts]), len(h)) if parts else np.zeros(0)
        c, mass, p1 = total(K + 1), total(K + 2), total(K + 3)
        for r in range(1, K + 1):
            mass = mass + total(r) * r * d[r]
        alpha = (1 - mass / np.maximum(c, 1)) / (1 - p1)
        value = np.log10(np.maximum(alpha, 1e-300)) + np.log10(np.maximum(c, 1))
        rows = [(MASSES, table.column("part")[0].as_py(), packed(h, c, alpha))]
        for k, x in zip(table.column("kind").to_pylist(), table.column("packed").to_pylist(), strict=True):
            if k == UNSEEN:
                batch, own, code, doc, times = unpacked(x)
                at = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
                found = np.where(h[at] == own, value[at], 0.0) if len(h) else np.zeros(len(own))
                docs_here, of = np.unique(doc, return_inverse=True)
                rows.append((UNSEEN, int(batch[0]), packed(docs_here.astype(np.uint32), np.bincount(of, times * found[code], len(docs_here)))))
        cols = list(zip(*rows, strict=True))
        return pa.table({"kind": pa.array(cols[0], pa.int32()), "part": pa.array(cols[1], pa.int64()), "packed": pa.array(cols[2], pa.binary())})

    dealt = answers.where(F.col("kind").isin(MASSES, UNSEEN)).select("kind", "part", "packed", named.alias("label")).groupBy("label")
    dealt.applyInArrow(weigh, "kind int, part long, packed binary").write.partitionBy("kind").parquet(folder)
    return answers.sparkSession.read.schema("part long, packed binary, kind int").parquet(folder).where(F.col("kind") == UNSEEN)


def score_documents(docs: DataFrame, held_out, cell_tokens: int = CELL_TOKENS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `held_out` is a boolean column; the model learns from all rows where it is
    false or null. Tokens are words between ASCII white space, A-Z
    lower-cased, and one end; null and empty texts have the end alone.
    base_score is that of the add-one unigram model, score the Katz model's,
    both log10 of the whole text's probability. Repeated rows count as often
    as they occur and each have a row; null doc_ids are kept; other columns
    are ignored; an empty table gives none, and without training rows every
    word is the unknown one, of probability 1.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    top, parts = new_folder(spark, "katz"), partitions(spark)
    manifest = count_words(source, f"{top}-words", parts)
    tokens, words = sum(r["tokens"] for r in manifest), sum(r["words"] for r in manifest)
    n = [sum(r["n"][k] for r in manifest) for k in range(K + 2)]
    d = discounts(n)
    mass = sum(d[r] * r * n[r] for r in range(1, K + 1)) + sum(r["rest"] for r in manifest)
    model = {"tokens": tokens, "d": d, "unknown": 1 - mass / tokens if tokens else 1.0, "pieces": parts}
    slices = max(1, -(-words // slice_words))
    ranges = max(1, -(-max(parts, tokens // cell_tokens) // slices))
    labels = balanced_labels(spark, slices * ranges)
    answers = count_pairs(pair_batches(source, slices, ranges, labels), manifest, slices, ranges, model, f"{top}-answers")
    stats = answers.where(F.col("kind") == STATS).select(F.array(*[F.sum(F.get("n", F.lit(k))) for k in range(K + 2)])).first()[0]
    d2 = discounts([x or 0 for x in stats])
    backed = back_off(answers, d2, balanced_labels(spark, ranges), f"{top}-model")
    trained = source.where("NOT held").count()
    logs = np.log10(np.maximum(d2[1:] * np.arange(1, K + 1), 1e-300))
    norm, begin = np.log10(tokens + words + 1.0), np.log10(max(1, trained))

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        ids, null, held, size = [], [], [], []
        blobs = list(zip(table.column("kind").to_pylist(), table.column("packed").to_pylist(), strict=True))
        for k, x in blobs:
            if k == HEADS:
                ids, null, held, size = unpacked(x)
        base, score, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for k, x in blobs:
            if k == DOCS:
                at, have, *small, of_base, fixed = unpacked(x)
                known[at] += have
                base[at] += of_base
                score[at] += fixed + sum(s * v for s, v in zip(small, logs, strict=True))
            elif k == UNSEEN:
                at, value = unpacked(x)
                score[at] += value
        n_tokens = np.asarray(size).astype(np.int64)
        doc_id = pa.array(np.asarray(ids), pa.int64(), mask=np.asarray(null).astype(bool))
        return pa.table({"doc_id": doc_id, "held_out": pa.array(np.asarray(held).astype(bool)), "n_tokens": n_tokens, "n_known": known, "train_tokens": np.full(len(n_tokens), tokens, np.int64), "base_score": base - n_tokens * norm, "score": score - begin})

    both = answers.where(F.col("kind").isin(DOCS, HEADS)).select("kind", "part", "packed").unionByName(backed.select("kind", "part", "packed"))
    return both.groupBy("part").applyInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
