"""Retrieval in blocks against counting pairs one by one."""

from __future__ import annotations

from collections import Counter

import pytest

from claimloom.operators import retrieve, shared_terms

DOCS = [(i, " ".join(f"w{'abcdefgh'[j]}{'xyz'[i % 3]}zz" if (i >> j) % 2 else f"common {'qrst'[i % 4] * 5}" for j in range(6))) for i in range(90)]
DOCS += [(7, "common waxzz again"), (7, None), (None, "common waxzz wbyzz"), (None, "common"), (200, ""), (2**62, "common rrrrr waxzz")]
ASKED = [("a", "common waxzz wbyzz unknown"), ("b", "Common qqqqq"), ("b", "common, waxzz"), (None, "rrrrr wczzz"), ("c", ""), ("d", None)]


def words(text):
    import re

    return set(re.findall("[a-z]{4,}", (text or "").lower()))


def expected(k, common=None):
    df = Counter(w for _, t in DOCS for w in words(t))
    drop = {w for w, n in df.items() if common is not None and n > len(DOCS) * common}
    found = Counter()
    for r, q in ASKED:
        for i, t in DOCS:
            if n := len((words(q) - drop) & words(t)):
                found[r, i] += n
    out = []
    for r in {r for r, _ in ASKED}:
        best = sorted((-n, i is None, i or 0, i) for (x, i), n in found.items() if x == r)[:k]
        out += [(r, at, i, -n) for at, (n, _, _, i) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("common", [None, 0.2])
def test_rows_and_no_pairs(spark, monkeypatch, common):
    """Repeated, missing and large ids, several blocks, the count of
    pairs never in a row each."""
    monkeypatch.setattr(shared_terms, "DOCUMENTS", 8)
    monkeypatch.setattr(shared_terms, "REQUESTS", 2)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(ASKED, "request_id string, question string")
    out = retrieve.retrieve(asked, docs, 5, common=common)
    assert sorted(map(tuple, out.collect()), key=str) == expected(5, common)
    # one row for each of the k best of a task: no join on terms, whose rows grow with the pairs
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Inner, (term" not in plan


def test_other_ids(spark):
    docs = spark.createDataFrame([("p10", "alpha beta"), ("p9", "alpha"), ("p1", "beta alpha")], "page string, text string")
    asked = spark.createDataFrame([(1, "alpha beta")], "request_id long, question string")
    out = retrieve.retrieve(asked, docs, 2, id_col="page")
    assert sorted(map(tuple, out.collect())) == [(1, 1, "p1", 2), (1, 2, "p10", 2)]


def test_frequent_terms_counted_once_and_not_packed(spark, monkeypatch):
    """Documents are read for the frequent terms, their number, repeated ids
    and the blocks, and these hold no term that no request may ask for."""
    monkeypatch.setitem(globals(), "DOCS", [*DOCS[:90], *DOCS[-2:], (91, None)])  # no id twice
    packed = []
    pack = shared_terms._pack
    monkeypatch.setattr(shared_terms, "_pack", lambda *a: packed.append(out := pack(*a)) or out)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1).mapInArrow(counted, "doc_id long, text string")
    asked = spark.createDataFrame(ASKED, "request_id string, question string")
    out = retrieve.retrieve(asked, docs, 5, common=0.2)
    assert sorted(map(tuple, out.collect()), key=str) == expected(5, 0.2)
    assert seen.value <= 4 * len(DOCS)
    df = Counter(w for _, t in DOCS for w in words(t))
    found, held = [], set()
    for row in packed[0].collect():
        ids, sizes, codes, counts, vocabulary = shared_terms._unpacked(row.block)
        terms = iter(vocabulary.take(codes).to_pylist())
        found += [(i, sorted(next(terms) for _ in range(n))) for i, n in zip(ids.to_pylist(), sizes.tolist())]
        held |= {*vocabulary.to_pylist()}
    rare = {w for w, n in df.items() if n <= len(DOCS) * 0.2}
    assert held == rare and len(rare) < len(df)
    assert sorted(found) == sorted((i, sorted(words(t) & rare)) for i, t in DOCS)


def test_query_counts_frequent_terms(spark, tmp_path):
    """40 documents share a word, far more than a fiftieth of them."""
    from claimloom.plans.queries import QUERIES, SQL

    docs = [(i, "common words" + (" seldom" if i in (7, 9) else "")) for i in range(40)]
    asked = [(1, 0, "user", "common seldom"), (1, 1, "assistant", "words"), (2, 0, "user", "Words!"), (3, 0, "user", "unknown")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = [("1-0", at, i, 2 if at < 3 else 1) for at, i in enumerate([7, 9, *range(7), 8], 1)]
    want += [("2-0", i + 1, i, 1) for i in range(10)]
    out = QUERIES["retrieve_topk"](spark, str(tmp_path)).select("request_id", "rank", "doc_id", "n_shared")
    assert sorted(map(tuple, out.collect())) == want
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(SQL["retrieve_topk"]).fetchall()) == want


@pytest.mark.parametrize("most", [1, 3, 70])
@pytest.mark.parametrize("postings", [1, 30, 1 << 18])
def test_skipped_documents_change_nothing(monkeypatch, most, postings):
    """Ties, missing ids, counts and block after block, against scores of all pairs."""
    import random

    import pyarrow as pa

    monkeypatch.setattr(shared_terms, "CHUNK", 7)
    monkeypatch.setattr(shared_terms, "POSTINGS", postings)
    rnd = random.Random(most * postings)
    terms = [f"w{i}" for i in range(60)]

    def drawn(n, at_most):
        return [Counter({w: rnd.randint(1, most) for w in rnd.choices(terms, [1 / (i + 1) for i in range(60)], k=rnd.randint(0, at_most))}) for _ in range(n)]

    def block(ids, rows):
        lists = [[list(r) for r in rows], [list(r.values()) for r in rows]]
        columns = [pa.array(ids, pa.int64()), pa.array(lists[0], pa.list_(pa.string())), pa.array(lists[1], pa.list_(pa.int64()))]
        return shared_terms._packed(pa.table(columns, ["id", "terms", "counts"]), shared_terms.NONE)

    asked, ids = drawn(30, 20), rnd.sample(range(1000), 400)
    held, scores = shared_terms.Asked(block(range(30), asked), 4), []
    for at in range(0, 400, 80):
        docs, some = drawn(80, 25), [None if rnd.random() < 0.03 else i for i in ids[at : at + 80]]
        held.meet(block(some, docs))
        scores += [(r, i, sum(n * d[w] for w, n in q.items())) for r, q in enumerate(asked) for i, d in zip(some, docs)]
    want = []
    for r in range(30):
        mine = [x for x in scores if x[0] == r and x[2]]
        want += sorted((x for x in mine if x[1] is not None), key=lambda x: (-x[2], x[1]))[:4] + [x for x in mine if x[1] is None]
    found = held.rows(pa.schema([("r", pa.int64()), ("i", pa.int64()), ("n", pa.int64())])).to_pylist()
    assert sorted((tuple(x.values()) for x in found), key=str) == sorted(want, key=str)
