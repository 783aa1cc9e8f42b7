"""Secrets, personal data and toxicity."""

from __future__ import annotations

import base64
import random
import re
from zlib import crc32

from claimloom.llm import pii, secrets, toxicity
from tests.llm.util import TEXTS, docs, none


def plain_secrets(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        out += [(*m.span(), "assign")] if len(m[2]) >= 12 else []
    out += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_base_secrets():
    rng = random.Random(1)
    parts = [*"abAK=:\"' 09ſK_", "token", "ToKen=", "api_key", "apikey:", "AKIA", "password = ", "deadbeef01", "secret"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert secrets.base_spans(t) == plain_secrets(t)


def test_random_tokens_are_found(spark):
    rng = random.Random(2)
    made = [base64.urlsafe_b64encode(rng.randbytes(24)).decode() for _ in range(20)] + [rng.randbytes(20).hex().upper() for _ in range(20)]
    plain = ["thisIsAnOrdinaryIdentifier2024", "user_profile_image_1234567", "2024-01-15-report-final-v2", "aaaaaaaaaaaaaaaaaaaa11111111111"]
    texts = [(i, f"see {t} here") for i, t in enumerate(made + plain * 5)] + [(1000 + i, t) for i, t in TEXTS]
    got = {r.doc_id: r for r in secrets.secrets(docs(spark, texts)).collect()}
    assert sum(got[i].n_random for i in range(40)) >= 38
    assert all(got[i].n_random == 0 for i in got if i >= 40)
    assert got[0].spans == f"random:4:{4 + len(made[0])}"
    assert got[1003].spans == "" and got[1003].n_hex == 0
    assert secrets.secrets(none(spark)).isEmpty()


def test_masking(spark):
    text = 'set password = "abcdefabcdef0123456789" and token: zzzzzzzzzzzzz now'
    d = docs(spark, [(1, text), (2, None), (3, "nothing")])
    got = [r[0] for r in d.select(secrets.masked_column("text", 300)).collect()]
    assert got == ["set [secret]\" and [secret] now", None, "nothing"]


def plain_pii(t):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        out += [(*m.span(), "ip")] if all(int(p) <= 255 for p in m[0].split(".")) else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        luhn = sum(x if i % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for i, x in enumerate(d)) % 10 == 0
        out += [(*m.span(), "card")] if 12 <= len(d) <= 19 and luhn else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        out += [(*m.span(), "phone")] if 9 <= sum(c.isdigit() for c in m[0]) <= 15 else []
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_personal_data():
    rng = random.Random(3)
    parts = [*"ab.@-+ ()1234056789%_é", ".com", "@x", "0.0.", "+49 ", "1234", "4111111111111111"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain_pii(t)


def test_long_runs_are_linear():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "token" + " " * 200_000, "@" * 100_000):
        pii.base_spans(t)
        secrets.base_spans(t)


def test_personal_data(spark):
    rng = random.Random(4)
    texts = [(i, f"please call phone 030 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} now") for i in range(40)]
    texts += [(100 + i, f"build version {rng.randrange(10**7, 10**8)}x done") for i in range(40)]
    texts += [(200, "write to a.b@mail.example.com from 10.0.0.1"), (201, None), (201, ""), (202, "x" * 100_000)]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, texts)).collect()}
    assert sum(got[i].n_more for i in range(40)) >= 36
    assert sum(got[100 + i].n_more for i in range(40)) <= 4
    assert got[200].spans == "email:9:29,ip:35:43" and (got[200].n_email, got[200].n_ip) == (1, 1)
    assert got[201].spans == "" and got[202].spans == ""
    assert pii.personal_data(none(spark)).isEmpty()


def test_reliabilities_prefer_consistent_labelers():
    p = pii.reliabilities({(1, 1, 1): 400, (-1, -1, -1): 400, (1, -1, 1): 30, (-1, 1, -1): 30, (1, 1, -1): 30})
    assert p[1, 1, 1] > 0.9 > 0.1 > p[-1, -1, -1] and p[1, -1, 1] > 0.5


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulrnst") for _ in range(rng.randrange(2, 8))) for _ in range(800)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        y = int(rng.random() < 0.3)
        for _ in range(y * (1 + len(w) // 40)):
            bad = rng.choice(["wretchedfool", "vilescum", "stupidoaf"])
            w[rng.randrange(len(w))] = bad if rng.random() < 0.8 else bad[:-1] + "z" + bad[-1]
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = corpus(900, 1)
    d = docs(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, "vilescums wretchedfo0l stupidoafs vilescum")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (7777, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert all(got[i].held_out == (crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.93
    assert got[5000].score == got[5001].score and 0 <= got[5000].score < 0.5
    assert got[5002].score > got[5001].score


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs(spark), labels).where("predicted = 1").isEmpty()
    assert toxicity.toxicity(none(spark), labels).isEmpty()
