"""Equal cuts stay in one island, whatever order they come in."""

import random

from roadloom.operators import relational


def test_equal_cuts_are_never_in_two_islands(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.choice(range(2, 390, 5))), 400.0) for k in range(40) for _ in range(60)]
    rows += [(99, 10.0, 400.0)] * 7 + [(99, 14.0, 400.0)] * 7
    got = {}
    for r in relational.merged_cuts(spark.createDataFrame(rows, "k int, s double, len double"), "k", "s", "len", 3.0).collect():
        got.setdefault(r.k, []).append((r.s, r.n))
    for k in {r[0] for r in rows}:
        own = [s for i, s, _ in rows if i == k]
        assert sorted(got[k]) == sorted((s, own.count(s)) for s in set(own))  # all gaps are 4 or more
