"""Operator 8 against a brute-force model, whose probabilities after every history add up to one."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadloom.llm.katz import score_documents

K = 5


def discount(n):
    out = {}
    for r in range(1, K + 1):
        t = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0
        out[r] = t if 0 < t < 1 else (r + 1) / (r + 2)
    return lambda c: out[c] * c if c <= K else c * (c + 1) / (c + 2)


def tokens(text):
    return [*[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w], None]


class Brute:
    def __init__(self, texts):
        pairs = [p for t in texts for p in zip(["<s>", *tokens(t)], tokens(t), strict=False)]
        self.c1, self.c2, self.ch = Counter(w for _, w in pairs), Counter(pairs), Counter(h for h, _ in pairs)
        self.n = len(pairs)
        self.d1, self.d2 = discount(Counter(self.c1.values())), discount(Counter(self.c2.values()))
        self.unknown = 1 - sum(map(self.d1, self.c1.values())) / self.n if self.n else 1.0
        self.after = {}
        for h, w in self.c2:
            self.after.setdefault(h, []).append(w)

    def p1(self, w):
        return self.d1(self.c1[w]) / self.n if w in self.c1 else self.unknown

    def p(self, h, w):
        if not self.ch[h]:
            return self.p1(w)
        if self.c2[h, w]:
            return self.d2(self.c2[h, w]) / self.ch[h]
        left = 1 - sum(self.d2(self.c2[h, x]) for x in self.after[h]) / self.ch[h]
        return left / (1 - sum(map(self.p1, self.after[h]))) * self.p1(w)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(h, w)) for h, w in zip(["<s>", *t], t, strict=False))

    def base(self, text):
        return sum(math.log10((self.c1[w] + 1) / (self.n + len(self.c1) + 1)) for w in tokens(text))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("cell, words", [(10_000_000, 10_000_000), (50, 7)])
def test_scores_are_the_models(spark, cell, words):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(40))) + (f" New{i}" if i % 5 == 0 else "")) for i in range(120)]
    rows += [(i + 120, "licensed under terms " * 4) for i in range(12)]
    rows += [(500, None), (501, ""), (502, " \t"), (None, "w1 W2"), (3, rows[3][1]), (3, rows[3][1]), (10, "other text"), (504, "w1 w2 " * 3000)]
    model = Brute([t for i, t in rows if not held(i)])
    for h in [*model.ch, "never"]:
        assert abs(sum(model.p(h, w) for w in [*model.c1, "<unk>"]) - 1) < 1e-9
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    column = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = sorted((tuple(r) for r in score_documents(docs, column, cell, words).collect()), key=lambda r: (str(r[0]), r[5]))
    want = sorted(((i, held(i), len(tokens(t)), sum(w in model.c1 for w in tokens(t)), model.n, model.base(t), model.score(t)) for i, t in rows), key=lambda r: (str(r[0]), r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-6)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = score_documents(docs, F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in sorted(got)] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert score_documents(docs.limit(0), F.lit(False)).count() == 0
