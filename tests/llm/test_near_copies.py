"""Near copies against brute force over all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from claimloom.llm import near_copies
from tests.llm.util import TEXTS, docs, none


def plain_sets(texts):
    out = {}
    for i, t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def kept_ids(sets):
    """Smallest ids of the groups."""
    ids = sorted(sets)
    label = {i: i for i in ids}
    pairs = [(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sorted(set(label.values())), len(pairs)


@pytest.mark.parametrize("small", [near_copies.SMALL, 3])
def test_one_of_each_group_stays(spark, monkeypatch, small):
    monkeypatch.setattr(near_copies, "SMALL", small)
    rng = random.Random(11)
    texts = list(dict(TEXTS).items())
    for g in range(30):  # families at similarities around 0.8
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 300]))]
        for k in range(rng.choice([2, 3, 25])):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 40)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
            texts.append((1000 * (g + 1) + k, " ".join(w)))
    want, n = kept_ids(plain_sets(texts))
    assert n > 300
    d = docs(spark, texts)
    out = corpus_pipeline.drop_near_duplicates(spark, d, "")
    assert sorted(r.doc_id for r in out.collect()) == want and out.columns == d.columns


def test_repeated_rows_and_none(spark):
    d = docs(spark, [(1, "a b c d e"), (1, "a b c d e"), (2, "q r s t u v w")])
    assert sorted(r.doc_id for r in near_copies.keep_one(d).collect()) == [1, 2]
    assert near_copies.keep_one(none(spark)).isEmpty()


def test_similar_sizes_share_a_class():
    import numpy as np

    sizes = np.arange(1, 3000)
    low, high = near_copies.classes(sizes)
    assert set((high - low).tolist()) == {0, 1}
    for a in sizes.tolist():
        b = np.arange(a, a * 5 // 4 + 1)
        mine, theirs = {low[a - 1], high[a - 1]}, near_copies.classes(b)[0]
        assert all(t in mine for t in theirs.tolist())


def test_common_passage_makes_no_rows_for_pairs(spark, monkeypatch):
    """Texts of which half is one passage meet in large buckets; what the
    sketches reject must be rejected there, not in rows of pairs."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    shared = [word() for _ in range(120)]
    docs = [(i, " ".join(shared + [word() for _ in range(70)])) for i in range(300)]
    docs += [(1000 + i, docs[i][1] + " end") for i in range(0, 300, 10)]
    monkeypatch.setattr(near_copies, "SMALL", 2)  # all buckets but pairs are compared in full
    counts, real = [], near_copies._near

    def counted(pairs, nodes, scratch):
        counts.append(pairs.count())
        return real(pairs, nodes, scratch)

    monkeypatch.setattr(near_copies, "_near", counted)
    kept = near_copies.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))
    assert max(counts) < 30 * len(docs)  # 19,677 when all pairs were rows
