"""Gradients of the toxicity model against finite differences."""

from __future__ import annotations

import numpy as np

from claimloom.llm import toxicity


def test_gradients():
    rng = np.random.default_rng(3)
    uniq = np.array([2, 5, 7, 11], np.int32)
    n = np.array([3, 2, 4])
    inverse = np.array([0, 1, 2, 1, 3, 0, 1, 2, 3], np.int32)
    values = rng.uniform(0.5, 2, 9).astype(np.float32)
    batch = uniq, inverse, values, n, np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])
    raw, out, base, scale = rng.normal(size=(16, 3)), rng.normal(size=(3, 2)), np.array([0.2, -0.1]), 0.7
    # in double precision: finite differences need it
    loss, by_rows, by_out, by_base = toxicity.gradients(raw, out, base, batch, scale)

    def numeric(x, i):
        x[i] += 1e-5
        up = toxicity.gradients(raw, out, base, batch, scale)[0]
        x[i] -= 2e-5
        down = toxicity.gradients(raw, out, base, batch, scale)[0]
        x[i] += 1e-5
        return (up - down) / 2e-5

    for k, r in enumerate(uniq):
        for j in range(3):
            assert abs(numeric(raw, (r, j)) - scale * by_rows[k, j]) < 1e-4
    for i in np.ndindex(out.shape):
        assert abs(numeric(out, i) - by_out[i]) < 1e-4
    for i in range(2):
        assert abs(numeric(base, i) - by_base[i]) < 1e-4


def test_ids_labelled_or_written_twice(spark):
    d = spark.createDataFrame([(i, t) for i in range(1, 9) for t in (f"b {i}", f"a {i}")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(1, 9) for y in (0, i % 2)], "doc_id long, toxic int")
    rows = toxicity.sample_labelled(d, labels, "doc_id", "text", "toxic", 3).collect()
    assert len(rows) == 6 and all(r.text == f"a {r.id}" and r.y == r.id % 2 for r in rows)
