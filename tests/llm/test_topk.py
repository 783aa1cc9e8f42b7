"""Exact top-k against sorting."""

from __future__ import annotations

import math
import random

from claimloom.llm import topk


def brute(rows, k):
    q = {i: topk.quantise(v) for i, v in rows if i % 20 == 0}
    out = []
    c = [(i, w) for i, v in rows if (w := topk.quantise(v)) is not None]
    for i, w in q.items():
        if w is not None:
            s = sorted((-sum(a * b for a, b in zip(w, x)), j) for j, x in c if j != i)[:k]
            out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -n))) for r, (n, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, score long, rank int")
    return sorted(map(tuple, topk.top_k(df.where("vec_id % 20 = 0"), df, k).collect()))


def test_random(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.1, -0.2, 0.5]) for _ in range(6)]) for i in range(300)]
    rows += [(1000, None), (1020, [0.1, None]), (1040, [math.nan]), (1060, [math.inf, 0.0]), (1080, [0.5, 0.5]), (1081, [])]
    assert run(spark, rows, 7) == brute(rows, 7)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(400)]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_extremes_few_rows_and_none(spark):
    rows = [(0, [1e9, 1e9]), (1, [1e9, -3e7]), (20, [-1e9, 5e8])]
    assert run(spark, rows, 20) == brute(rows, 20)
    assert run(spark, [(1, [1.0])], 3) == []
    assert run(spark, [(20, [1.0])], 3) == []


def test_repeated_candidates_count(spark):
    assert run(spark, [(0, [1.0]), (7, [2.0]), (7, [2.0]), (8, [1.0])], 2) == [(0, 1, 7, 8192), (0, 2, 7, 8192)]


def test_tasks_do_not_grow_with_pairs_of_blocks(spark, monkeypatch):
    """Many blocks of both sides: few partitions, exact results."""
    monkeypatch.setattr(topk, "CANDIDATES", 8)
    monkeypatch.setattr(topk, "QUERIES", 1)
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.3, -0.2]) for _ in range(3)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")  # 40 blocks of queries, 100 of candidates
    out = topk.top_k(asked, df, 4)
    assert sorted(map(tuple, out.collect())) == brute(rows, 4)
    assert "RoundRobinPartitioning(4000)" not in out._jdf.queryExecution().executedPlan().toString()
