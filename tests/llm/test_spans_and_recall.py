"""Long span lists, and planted secrets and personal data."""

from __future__ import annotations

import base64
import random
import time

from claimloom.llm import pii, secrets
from claimloom.llm.common import free
from tests.llm.util import docs


def test_free_spans():
    rng = random.Random(1)
    for _ in range(500):
        taken = sorted((s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(6))))
        spans, at = [], 0
        while at < 60:
            at += rng.randrange(5)
            end = at + rng.randrange(1, 6)
            spans.append((at, end, "x"))
            at = end
        assert free(taken, spans) == [x for x in spans if not any(s < x[1] and x[0] < e for s, e in taken)]


def test_a_hundred_thousand_spans():
    began = time.time()
    text = "10.0.0.1 call 030 123 4567 now; " * 100_000
    assert len(pii.candidates(text, pii.base_spans(text))) == 100_000
    text = "token=abcdefabcdef12 aB3dE5fG7hI9kL1m " * 50_000
    letters = secrets.letter_chances(secrets.pair_counts(text))
    assert len(secrets.candidates(text, secrets.base_spans(text), letters)) == 50_000
    assert time.time() - began < 60


def test_random_tokens_of_many_lengths(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    planted = {}
    texts = []
    for i in range(900):
        w = [word() for _ in range(60)]
        if i % 3 == 0:
            n = rng.choice([16, 24, 40, 100, 400, 2000])
            encode = base64.urlsafe_b64encode if i % 2 else base64.b64encode
            planted[i] = encode(rng.randbytes(n)).decode()[:n].strip("-_")
            w[30] = planted[i]
        elif i % 3 == 1:
            w[30] = rng.choice(["user_profile_image_1234567", "2024-01-15-report-final-v2", "thisIsAnOrdinaryIdentifier2024"])
        texts.append((i, " ".join(w)))
    got = {r.doc_id: r.n_random + r.n_hex for r in secrets.secrets(docs(spark, texts)).collect()}
    caught = sum(got[i] > 0 for i in planted) / len(planted)
    false = sum(got[i] > 0 for i in got if i not in planted)
    assert caught >= 0.95 and false <= 3


def test_planted_personal_data(spark):
    rng = random.Random(6)
    texts, planted = [], set()
    for i in range(600):
        w = ["lorem", "ipsum", "dolor", "sit"] * 10
        if i % 2:
            w[20:20] = rng.choice([
                ["contact", f"ann{i} (at) example (dot) org", "today"], ["phone", f"030 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}", "daily"],
                ["account", str(rng.randrange(10**9, 10**10)), "is"],
            ])
            planted.add(i)
        else:
            w[20:20] = rng.choice([["version", f"{rng.randrange(10**7, 10**8)}x"], ["order", f"{rng.randrange(10**6, 10**7)}$"], ["page", "12"]])
        texts.append((i, " ".join(w)))
    got = {r.doc_id: r.n_more for r in pii.personal_data(docs(spark, texts)).collect()}
    caught = sum(got[i] > 0 for i in planted) / len(planted)
    false = sum(got[i] > 0 for i in got if i not in planted)
    assert caught >= 0.9 and false <= 0.1 * len(planted)
