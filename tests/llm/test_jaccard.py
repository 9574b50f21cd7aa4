"""Operator 9 against brute force over all pairs."""

import random
import re

import pyarrow as pa

from roadloom.llm.common import written
from roadloom.llm.components import components
from roadloom.llm.jaccard_join import bound, prefix_length, similar_groups
from roadloom.llm.word_hash import word_hashes


def brute(rows, width=5, percent=80):
    sets, label = [], {}
    for doc_id, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
        if doc_id is not None:
            label[doc_id] = doc_id
    changed = True
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            a, b = rows[i][0], rows[j][0]
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sorted(((d, len(s), None if d is None else label[d]) for (d, _), s in zip(rows, sets, strict=True)), key=repr)


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(2000)]
    rows, n = [], 0
    passage = rng.choices(words, k=60)
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([1, 4, 5, 6, 30, 90, 200]))
        if rng.random() < 0.4:
            base = base + passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            x = list(base)
            for _ in range(rng.randrange(4)):
                x[rng.randrange(len(x))] = rng.choice(words)
            if rng.random() < 0.5:
                x += rng.choices(words, k=rng.randrange(12))
            rows.append((n, " ".join(x).upper() if rng.random() < 0.2 else "\n".join(x)))
            n += 1
    chain = rng.choices(words, k=100)  # each like the next one only
    for i in range(0, 60, 4):
        rows.append((n, " ".join(chain[i : i + 80] + [f"z{j}" for j in range(i, i + 3)])))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[3][1]), (5, rows[5][1]), (n + 3, "a b"), (n + 4, "A\tb"), (n + 5, "very long " * 20000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_shingles string, node int")
    got = sorted([tuple(r)[:3] for r in similar_groups(docs).collect()], key=repr)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows) - 20
    assert similar_groups(docs.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (300, 301)]
    for most in (7, 1000):
        got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), task_links=most).collect()}
        assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_pair_between_components_is_lost(spark):
    """All pairs under the filters, whichever side asks, against a plain join of the lists."""
    from roadloom.llm.jaccard_join import candidates_between

    rng = random.Random(8)
    label = {i: rng.choice([i, -5, 3, 900]) for i in range(40)}
    rows = [(k, t, i, 10 + i % 3, 10 + rng.randrange(4), label[i]) for k in (0, 1) for t in range(30) for i in rng.sample(range(40), rng.randrange(2, 9))]
    lists = spark.createDataFrame(rows, "order int, token long, node long, n long, most long, label long")
    met = [{(min(x[2], y[2]), max(x[2], y[2])) for x in rows for y in rows if x[:2] == y[:2] and x[0] == k and x[5] != y[5] and x[3] <= y[4] and y[3] <= x[4]} for k in (0, 1)]
    for block in (1000, 3):
        got = {(r.a, r.b) for r in candidates_between(lists, 80, block).collect()}
        assert got == met[0] & met[1] and len(got) > 20


def test_words_that_a_polynomial_confuses_differ(spark):
    """The Thue-Morse word of 1,024 letters and its complement."""
    swap, word = str.maketrans("ab", "ba"), "a"
    while len(word) < 1024:
        word += word.translate(swap)
    docs = spark.createDataFrame([(1, word), (2, word.translate(swap))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_groups(docs).collect()} == {1: 1, 2: 2}
    words = [b"abcdefgh" * n + b"x" * k for n in range(40) for k in range(9)]
    hashes, counts = word_hashes([b" ".join(words)])
    assert counts.tolist() == [len(words) - 1] and len(set(hashes.tolist())) == len(words) - 1


def test_bounds_lose_no_similar_pair():
    """Of any two similar sets, some shared prefix token lets both through; here the first one."""
    rng = random.Random(4)
    for _ in range(3000):
        n, m, both = (rng.randrange(1, 40) for _ in range(3))
        if both > min(n, m) or 100 * both < 80 * (n + m - both):
            continue
        x, y = (sorted([*range(both), *rng.sample(range(100 * k, 100 * k + 90), size - both)], key=lambda t: (t * 7919) % 1009) for k, size in ((1, n), (2, m)))
        first = next(i for i, t in enumerate(x) if t in y)
        at = y.index(x[first])
        assert first < prefix_length(n, 80) and at < prefix_length(m, 80)
        assert m <= bound(n, first, 80) and n <= bound(m, at, 80)


def test_batches_are_small_only_while_a_table_is_written(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 100000) AS text").mapInArrow(sizes, "n long")
    found = [r["n"] for r in written(rows, "sizes").collect()]
    assert sum(found) == 400 and max(found) < 100
    assert spark.conf.get(setting) == before
