"""Near-duplicates, repeats and contamination against brute force."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from claimloom.llm import decontaminate, repeats, simhash
from claimloom.llm.common import components
from tests.llm.util import TEXTS, docs, none


def test_golay_balls():
    table, _ = simhash.golay()
    assert np.bincount((table >= 0).sum(1)).tolist() == [0, 277, 0, 0, 0, 0, 1771]


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    q = p.copy()
    for i in range(len(q)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            q[i] ^= np.uint64(1) << np.uint64(b)
    ra, ka = simhash.table_keys(p)
    rb, kb = simhash.table_keys(q)
    mine = set(zip(ra.tolist(), ka.tolist()))
    assert {r for r, k in zip(rb.tolist(), kb.tolist()) if (r, k) in mine} == set(range(len(p)))


def print_of(text):
    import xxhash

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(prints):
    """Smallest id reachable over links of four bits and fewer."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] > label[a] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[b], changed = label[a], True
    return label


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    texts = list(dict(TEXTS).items())
    for k in range(60):  # a family of near copies
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(300)] = f"w{rng.randrange(900)}"
        texts.append((100 + k, " ".join(w)))
    prints = {i: print_of(t) for i, t in texts}
    want = {i: (f"{prints[i]:016x}", c) for i, c in groups(prints).items()}
    assert len({c for i, (_, c) in want.items() if i >= 100}) < 50
    for tile in (simhash.TILE, 8):
        monkeypatch.setattr(simhash, "TILE", tile)
        rows = simhash.near_duplicates(docs(spark, texts)).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want
    kept = sorted(r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect())
    assert kept == sorted({c for _, c in want.values()})


def test_keep_one_of_repeated_rows(spark):
    d = docs(spark, [(1, "a b c d e"), (1, "a b c d e"), (2, "q r s t u v w")])
    out = simhash.keep_one(d)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2] and out.columns == d.columns
    assert simhash.keep_one(none(spark)).isEmpty() and simhash.near_duplicates(none(spark)).isEmpty()


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b:
                m = min(label[a], label[b])
                if label[a] != m or label[b] != m:
                    label[a] = label[b] = m
                    changed = True
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def without_repeats(texts):
    seen, out = {}, []
    for i, t in sorted({(i, t or "") for i, t in texts}, key=lambda x: (x[0], sha256(x[1].encode()).hexdigest())):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen[b[s : s + 100]] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        n = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), n, sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    dictionary = [b"banana", b"bandana", b"an"]
    order, _, starts = repeats.suffix_array(dictionary)
    joined, ends = b"".join(dictionary), np.repeat(starts + [6, 7, 2], [6, 7, 2])
    found = [joined[i : ends[i]] for i in order]
    assert found == sorted(found)


def test_windows_by_suffixes():
    rng = random.Random(1)
    for _ in range(100):
        pool = [bytes(rng.choice(b"ab") for _ in range(rng.choice([100, 101, 149]))) for _ in range(4)]
        bodies = [b if rng.random() < 0.6 else b[:100] + b"ab" * rng.randrange(15) for b in rng.choices(pool, k=rng.randrange(1, 12))]
        places = np.array([[rng.randrange(3), 0, rng.randrange(0, 400, 50)] for _ in bodies])
        at: dict[bytes, set] = {}
        for b, (i, t, lo) in zip(bodies, places.tolist()):
            for k in range(len(b) - 99):
                at.setdefault(b[k : k + 100], set()).add((i, t, lo + k))
        want = {p for v in at.values() for p in v if p != min(v)}
        assert {tuple(x) for x in repeats.repeated_windows(bodies, places).tolist()} == want


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BUCKET", 2 * hot)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9)))
    passage = [" ".join(word() for _ in range(n)) for n in (8, 19, 20, 40, 200)]
    texts = [(i, t) for i, t in TEXTS if i not in (6, 7)]
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(12))) if rng.random() < 0.5 else rng.choice(passage) for _ in range(rng.randrange(6))]
        texts.append((100 + i, rng.choice(["", " "]).join(parts)))
    got = sorted(set(map(tuple, repeats.remove_repeats(docs(spark, texts)).collect())))
    assert got == sorted(without_repeats(texts))
    assert repeats.remove_repeats(docs(spark, texts)).count() == len(texts)
    assert repeats.remove_repeats(none(spark)).isEmpty()


def contaminated(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            y = words(x)
            n = min(10, len(y))
            windows = {tuple(y[k : k + n]) for k in range(len(y) - n + 1)} if n else set()
            for s in range(len(w) - n + 1 if n else 0):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found.add(item)
        ids = ",".join(sorted(found - {None}))
        out.append((i, len(w), len(hit), len(found - {None}), sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("limit", [decontaminate.INDEX_WINDOWS, 25])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "INDEX_WINDOWS", limit)
    monkeypatch.setattr(decontaminate, "CHUNK", 2000)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(12)]
    items = [(str(k), " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 9, 10, 11, 30])))) for k in range(12)]
    items += [("7", items[3][1]), (None, "the lazy dog near"), ("n", None), ("é", "Ümläute é 漢字")]
    texts = list(TEXTS)
    for i in range(60):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(9)) for _ in range(4)]
        texts.append((100 + i, ", ".join(parts).upper()))
    b = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.decontaminate(docs(spark, texts), b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect())) == contaminated(texts, items)
    clean = docs(spark, texts).where(~decontaminate.contaminated_column("text", b)).count()
    assert clean == sum(not x[5] for x in contaminated(texts, items))
    assert decontaminate.decontaminate(docs(spark), b.where("item_id = 'none'")).where("contaminated").isEmpty()
    assert decontaminate.decontaminate(none(spark), b).isEmpty()


def test_repeats_leave_one_table(spark):
    """What has been read is deleted; the result reads the covers only."""
    from pathlib import Path

    from claimloom.llm import common

    at = Path(common.shared_folder(spark).removeprefix("file:"))
    files = lambda: {p.parent for p in at.rglob("*.parquet")} | set(at.glob("*/rdd-*"))
    before = files()
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(0, text), (1, f"first {text}"), (2, f"second {text} more"), (3, text), (4, "short")]
    out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(files() - before) <= 1
    assert [r.n_removed > 0 for r in out.orderBy("doc_id").collect()] == [False, True, True, True, False]


def test_bitmap_grows_with_its_hashes(spark):
    from pyspark.sql import functions as F

    rows = spark.range(40_000).select(F.xxhash64("id").alias("h"))
    bitmap = repeats._bitmap(rows, "h", 40_000).value
    held = np.array([r.h for r in rows.collect()], np.int64).view(np.uint64)
    others = np.array([r.h for r in spark.range(10**6, 10**6 + 40_000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
    assert repeats._in(bitmap, held).all() and repeats._in(bitmap, others.view(np.uint64)).mean() < 0.01
    assert len(bitmap) <= 2 * 40_000
