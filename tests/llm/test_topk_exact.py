"""Top-k against a brute force in fractions that shares no code with it."""

from __future__ import annotations

import random
from fractions import Fraction
from math import floor

from claimloom.llm import topk


def best(rows, k):
    w = [[floor(64 * Fraction(x)) for x in v] for _, v in rows]
    out = []
    for a, (i, _) in enumerate(rows):
        if i % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(w[a], w[b])), j) for b, (j, _) in enumerate(rows) if b != a)[:k]
            out += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(map(tuple, topk.top_k(df.where("vec_id % 20 = 0"), df, k).collect()))


def test_large_components(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0**26]), (2, [2.0**27])], 5) == [(0, 1, 2, 64 * 64 * 2**27), (0, 2, 1, 64 * 64 * 2**26)]
    rng = random.Random(4)
    for top in (2.0**20, 2.0**24, 2.0**26):
        rows = [(i, [rng.uniform(-top, top) if rng.random() < 0.3 else rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
        rows = [(i, [x if k else x / top for k, x in enumerate(v)]) for i, v in rows]
        want = [x for x in best(rows, 7)]
        if all(abs(s) < 2**63 for *_, s in want):
            assert run(spark, rows, 7) == want


def test_rows_that_share_a_querys_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.5]), (1, [0.5, 0.5]), (40, [2.0, 2.0]), (40, [2.0, 2.0])]
    assert run(spark, rows, 10) == best(rows, 10)
    assert run(spark, rows, 1) == best(rows, 1)
