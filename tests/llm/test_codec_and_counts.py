"""SentencePiece codec, greedy counts and license scans."""

from __future__ import annotations

import random
from array import array
from hashlib import sha256

import pytest

from claimloom.llm import license_scan, sentencepiece_codec, token_counts
from claimloom.llm.queries import piece_model
from tests.llm.util import TEXTS, docs, none


@pytest.fixture(scope="module")
def table():
    return sentencepiece_codec.table(piece_model())


def test_encoding_is_the_librarys(table):
    c = table.codec
    rng = random.Random(1)
    signs = [*" \n\t▁aethinorAZ09<>/sx", "　", "字", "😀", "\x00", "é", "\r", "  ", "<s>", "<0x0A>", "​"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [t or "" for _, t in TEXTS] + [" foo", "  foo", " ", "▁", "\n", "a" * 3000, " " * 40]
    for t in texts:
        ids = c.lib.encode(t, add_bos=True, add_eos=True)
        assert c.encode(t) == ids
        assert table.pack(t) == array("I", ids[1:-1]).tobytes()
        assert c.decode(ids) == c.lib.decode(ids)
    table.settle()


def test_decoding_any_ids(table):
    c = table.codec
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(8))]
        assert c.decode(ids) == c.lib.decode(ids)


def test_digests(spark, table):
    lib = table.codec.lib
    got = sorted(map(tuple, sentencepiece_codec.encode_digests(docs(spark), piece_model()).collect()))
    want = []
    for i, t in TEXTS:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha256(array("I", ids).tobytes()).hexdigest(), sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert sentencepiece_codec.encode_digests(none(spark), piece_model()).isEmpty()


def test_columns(spark, table):
    from pyspark.sql import functions as F

    df = docs(spark).select("text", sentencepiece_codec.encode_column("text", piece_model()).alias("ids"))
    df = df.select("text", sentencepiece_codec.decode_column("ids", piece_model()).alias("back"))
    assert df.where(F.coalesce("text", F.lit("")) != F.col("back")).count() == 1  # the literal space mark


def greedy(vocabulary, word):
    s, at, n = token_counts.MARK + word, 0, 0
    while at < len(s):
        for end in range(len(s), at, -1):
            p = s[at:end]
            if p in vocabulary and p.startswith(token_counts.MARK) == (at == 0):
                break
        else:
            return 0
        at, n = end, n + 1
    return n


def test_automaton_is_greedy():
    rng = random.Random(3)
    for _ in range(400):
        pieces = {("▁" if rng.random() < 0.4 else "") + "".join(rng.choice("abc") for _ in range(rng.randrange(5))) for _ in range(12)} - {""}
        a = token_counts.Automaton(sorted(pieces))
        for _ in range(20):
            w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
            assert a.count(w) == greedy(pieces, w)


def test_counts(spark, table):
    pieces = set(table.codec.ids)
    got = sorted(map(tuple, token_counts.token_counts(docs(spark), piece_model()).collect()))
    want = []
    for i, t in TEXTS:
        n = [0 if len(w) > token_counts.LONGEST else greedy(pieces, w) for w in (t or "").split()]
        want.append((i, len(n), sum(n) + n.count(0), n.count(0)))
    assert got == sorted(want)
    assert token_counts.token_counts(none(spark), piece_model()).isEmpty()


def test_licences(spark):
    texts = [(1, "Prose here.\nReleased under the MIT License.\nMore prose."), (2, "released UNDER the mit license"), (3, None), (4, ""),
             (5, "Licensed under the Apache License,\nVersion 2.0."), (6, "A license is a license."), (6, "A license is a license."),
             (7, "filler " * 20000 + "\nLicensed under CC BY-NC 4.0."), (8, "Licensed under CC BY 4.0.")]
    got = {r.doc_id: (r.n_matches, r.licenses) for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert got == {1: (1, "MIT"), 2: (1, "MIT"), 3: (0, ""), 4: (0, ""), 5: (1, "Apache-2.0"), 6: (0, ""), 7: (1, "CC-BY-NC-4.0"), 8: (1, "CC-BY-4.0")}
    assert license_scan.license_scan(none(spark)).isEmpty()


def test_size_bounds_lose_nothing():
    rng = random.Random(4)
    words = "licensed under the mit apache license version 2 0 released a b".split()
    t = license_scan.Templates()
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(14)))
        b = license_scan.bigrams(text)
        scores = [(2 * (b & x).total() / (b.total() + x.total()), n) for n, x, _ in t.all]
        best = max((s for s, _ in scores), default=0)
        found = t.best(text)
        assert (found is None) == (best < t.dice) and (found is None or found[0] == best)
