"""Operators 1, 2 and 7 against brute force, the libraries and exact round trips."""

import base64
import io
import math
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadloom.llm import token_files
from roadloom.llm.byte_bpe import codec, decode_ids, encode_texts
from roadloom.llm.hash_tree import Leaf, even_tree, grow, levels, shard_by_tree
from roadloom.llm.text_pieces import PieceCoder

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = st.text(st.sampled_from("ab é\n\t '\"1२中 \x1c\x85sS.,-| "), max_size=30) | st.text(max_size=30)
LATIN = st.lists(st.sampled_from(["Straße", "Ñandú", "a×b", "3÷4", " ", " ", "\n", "\n\n", "'", "'ll", "don't", "x9y", "###", "été,", "мир", "٣", "\u00a0", "\u3000", "ŉ", "\r", "z" * 40, "<|endoftext|>", "q" * 8, "w" * 16, "e" * 17]), max_size=12).map("".join)
SCHEMA = "doc_id long, text string, ids string, shard string"
ROWS = [(5, "b b", "x", "y"), (1, "", "x", "y"), (2, None, "x", "y"), (None, "null id", "x", "y"), (5, "b b", "x", "y"), (5, "a", "x", "y"), (7, "long " * 30000, "x", "y"), (8, "<|endoftext|> é\n \n  x", "x", "y")]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(text=ALPHABET | LATIN)
def test_bpe_is_as_the_library(library, text):
    own = codec(PATH, PATTERN)
    ids = own.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(text=ALPHABET | LATIN)
def test_encoder_is_as_the_tokenizers_library(whole, text):
    assert token_files.library_encoder(public_tokenizers.path("byte_bpe_50k.json"), PATTERN)()(text).tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.none() | ALPHABET | LATIN, max_size=8), most=st.sampled_from([4, 20, 1000]), keep=st.sampled_from([3, 10**6]))
def test_texts_are_coded_as_each_by_itself(library, texts, most, keep):
    own = codec(PATH, PATTERN).coder
    coder = PieceCoder(own.of_piece, own.find, keep)
    got = [(first + i, part.tolist()) for first, ids, n in coder.column(pa.array(texts, pa.string()), most) for i, part in enumerate(np.split(ids, np.cumsum(n)[:-1]))]
    assert got == list(enumerate(library.encode_ordinary(t or "") for t in texts))


def test_bpe_columns_round_trip(spark, library):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = encode_texts(docs, PATH, PATTERN)
    assert out.columns == ["doc_id", "text", "shard", "ids"]
    got = decode_ids(out, PATH, PATTERN).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert list(r.ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.bytes) == (r.text or "").encode()
    assert encode_texts(docs.limit(0), PATH, PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(0, 90), max_size=12), kind=st.sampled_from(["byte", "bit"]), block=st.sampled_from([1, 7, 64]))
def test_token_file_round_trip(lengths, kind, block):
    rng, out = np.random.default_rng(sum(lengths)), io.BytesIO()
    docs = [(i if i % 3 else None, rng.integers(0, 2**32, n, np.uint64).astype("<u4")) for i, n in enumerate(lengths)]
    writer = token_files.TokenFileWriter(out, kind, block)
    for k in range(0, len(docs), 5):
        run = docs[k : k + 5]
        writer.add([d for d, _ in run], np.concatenate([x for _, x in run]), np.array([len(x) for _, x in run]))
    writer.close()
    got = list(token_files.read_documents(out))
    assert [(d, ids.tolist()) for d, _, ids in got] == [(d, ids.tolist()) for d, ids in docs]
    assert [s for _, s, _ in got] == [sum(lengths[:i]) for i in range(len(lengths))]
    with pytest.raises(ValueError):
        token_files.read_index(io.BytesIO(out.getvalue()[:-3]))


def test_token_files_of_a_table(spark):
    rows = [*ROWS, *[(20 + i, "word " * 140_000, "x", "y") for i in range(5)]]  # of these, two lie in one part and not in one run
    docs = spark.createDataFrame(rows, SCHEMA)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, whole = token_files.library_encoder(path, PATTERN), Tokenizer.from_file(path)
    known = {t: whole.encode(t or "", add_special_tokens=False).ids for _, t, *_ in rows}
    for most in (10**6, 1):
        manifest = token_files.write_token_files(docs, encode, file_docs=most)
        assert manifest.count() == manifest.select("path").distinct().count() and (most > 1 or manifest.where("file > 0").count())
        got = token_files.read_token_files(manifest).orderBy("start").collect()
        start = 0
        for r, (doc_id, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
            ids = np.array([*known[text], 0], "<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), encode)).count() == 0


def test_shards_are_whole_gapless_and_move_only_into_the_new_one(spark):
    n = 3000
    docs = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 7 = 0 THEN NULL ELSE repeat('é', CAST(id % 5 AS INT)) END AS text", "1 AS shard", "2 AS slot")
    docs = docs.union(docs.where("doc_id < 40")).union(docs.selectExpr("CAST(NULL AS LONG)", "text", "1", "2").limit(3))
    for k in (3, 40, 41, 42):
        tree = even_tree(k)
        joins = Leaf(0, 0, k) if k % 2 else even_tree(k + 1)[-1]  # within the first rack, or where the next one would be
        got = shard_by_tree(docs, tree, grow(tree, [joins]), bucket_rows=7).toPandas()
        assert len(got) == docs.count()
        assert set(got["shard"]) <= set(range(k))
        assert (got["grown_shard"].eq(got["shard"]) | got["grown_shard"].eq(k)).all()
        assert 0 < got["grown_shard"].eq(k).sum() < 3 * n / k
        for _, rows in got.groupby("shard"):
            assert sorted(rows["slot"]) == list(range(len(rows)))
    row = got[got["doc_id"] == 3].iloc[0]
    assert (row["size"], row["text_crc32"]) == (16 + 6, zlib.crc32("ééé".encode()))
    assert got[got["doc_id"] == 7].iloc[0][["size", "text_crc32"]].tolist() == [16, 0]
    assert shard_by_tree(docs.limit(0), even_tree(4)).count() == 0


def test_weights_hold_and_confine_movement(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text")
    tree = [Leaf(0, 0, 0, 1.0), Leaf(0, 0, 1, 3.0), Leaf(0, 1, 2, 2.0), Leaf(1, 2, 3, 2.0)]
    heavier = [*tree[:3], Leaf(1, 2, 3, 4.0)]
    got = shard_by_tree(docs, tree, heavier).toPandas()
    share = got["shard"].value_counts(normalize=True)
    for x in tree:
        assert abs(share[x.shard] - x.weight / 8) < 0.02
    moved = got[got["shard"] != got["grown_shard"]]
    assert len(moved) and set(moved["grown_shard"]) == {3}


def test_every_key_descends_as_defined(spark):
    """The tree's definition, level by level, with the hash library."""
    tree = [Leaf(i % 3, 10 * (i % 3) + i % 4, i, 1.0 + i % 5) for i in range(20)] + [Leaf(0, 0, 90, 0.0)]
    tree = grow(grow(tree, [Leaf(1, 11, 20, 3.0), Leaf(5, 50, 21, 2.0)]), [Leaf(2, 23, 22, 6.0)])

    def draw(key, level, generation, n, weight):
        h = 42
        for value, kind in ((key, "<q"), (level, "<i"), (generation, "<i"), (n, "<i")):
            if value is not None:
                h = xxhash.xxh64_intdigest(struct.pack(kind, value), h)
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    def shard(key):
        _, g, _, racks = min(levels(tree), key=lambda x: draw(key, 0, x[1], x[0], x[2]))
        _, _, shards = min(racks, key=lambda x: draw(key, 1, g, x[0], x[1]))
        return min(shards, key=lambda x: draw(key, 2, g, x[0], x[1]))[0]

    keys = [None, -1, 2**62, *range(800)]
    got = shard_by_tree(spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string"), tree).toPandas()
    assert {None if math.isnan(k) else int(k): s for k, s in zip(got["doc_id"].tolist(), got["shard"].tolist(), strict=True)} == {k: shard(k) for k in keys}
    assert {20, 21, 22} < set(got["shard"]) and 90 not in set(got["shard"])
