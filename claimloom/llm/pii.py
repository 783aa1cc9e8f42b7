"""Personal data by weakly supervised span classification.

Base kinds (email, ip, card, phone) are fixed patterns.  Further
candidates are looser shapes; labelers - shape, length, borders, digit
variety, a gazetteer of announcing words, contexts that speak against -
each vote for, against or not at all.  Expectation-maximisation over the
counts of vote patterns of all documents estimates every labeler's
reliability and each pattern's posterior; a logistic span classifier is
then trained on the posteriors and decides.  Patterns are a fixed, small
set, so what reaches the driver does not grow with the input.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import free, join_spans, map_batches, trimmed

# Patterns of the base kinds and their order.  The
# look-behind only keeps the search from trying a run of digits again.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
MORE = ("mail_like", "phone_like", "number_like")
KINDS = BASE + MORE

MAIL_LIKE = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63})+", re.I
)
PHONE_LIKE = re.compile(r"(?<![0-9+(])\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9])")
NUMBER_LIKE = re.compile(r"(?<![0-9])[0-9]{7,24}(?![0-9])")
#: Words that announce personal data, by kind; words that speak against.
ANNOUNCING = {
    "mail_like": frozenset("mail email e-mail correo courriel contact contacto kontakt".split()),
    "phone_like": frozenset("tel phone call mobile fax telefon telefono teléfono téléphone handy".split()),
    "number_like": frozenset("ssn iban account passport id konto cuenta compte ausweis pasaporte passeport card".split()),
}
AGAINST = frozenset("version v page isbn issn doi year no nr vol sku order build revision".split())
WORD = re.compile(r"[^\W\d_][\w-]*")
#: Rounds of expectation-maximisation and of the classifier.
ROUNDS, STEPS = 50, 400


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base kinds by start, then kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        s = at  # the longest run of local signs that the last match left
        while s > last and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Looser spans that touch no base span and no earlier looser one."""
    out: list[tuple[int, int, str]] = []
    taken = sorted((s, e) for s, e, _ in base)
    for kind, pattern in zip(MORE, (MAIL_LIKE, PHONE_LIKE, NUMBER_LIKE)):
        if kind == "mail_like" and "at" not in text.lower():
            continue
        found = free(taken, ((*m.span(), kind) for m in pattern.finditer(text)))
        taken = list(merge(taken, [(s, e) for s, e, _ in found]))
        out += found
    return out


def votes(text: str, span: tuple[int, int, str]) -> tuple[int, ...]:
    """Votes of the labelers: 1 for, -1 against, 0 none."""
    s, e, kind = span
    body, before, after = text[s:e], text[max(0, s - 40) : s], text[e : e + 1]
    digits = _digits(body)
    words = [w.lower() for w in WORD.findall(before)][-4:]
    variety = len(set(digits or body))
    usual = {"mail_like": 8 <= len(body) <= 60, "phone_like": 9 <= len(digits) <= 12,
             "number_like": 8 <= len(digits) <= 16}[kind]
    return (
        1 if kind != "number_like" else 0,
        1 if usual else -1,
        -1 if (before[-1:].isalnum() or after.isalnum() or before[-1:] in "$€£#") and before[-1:] + after else 1,
        1 if variety >= 4 else -1 if variety <= 2 else 0,
        1 if ANNOUNCING[kind].intersection(words) else 0,
        -1 if AGAINST.intersection(words) else 0,
    )


def reliabilities(counts: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Posterior of every vote pattern by expectation-maximisation over
    two classes with independent labelers."""
    if not counts:
        return {}
    patterns = np.array(list(counts))
    n = np.array(list(counts.values()), float)
    p = np.clip(0.5 + 0.15 * patterns.sum(1), 0.05, 0.95)  # a majority vote to begin with
    for _ in range(ROUNDS):
        logit = np.zeros(len(p))
        for q, sign in ((p, 1), (1 - p, -1)):
            w = n * q
            like = np.full(len(p), np.log((w.sum() + 1) / (n.sum() + 2)))
            for k in range(patterns.shape[1]):
                for v in (-1, 0, 1):
                    at = patterns[:, k] == v
                    like[at] += np.log((w[at].sum() + 1) / (w.sum() + 3))
            logit += sign * like
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(counts, p.tolist()))


def features(kind: str, pattern: tuple[int, ...]) -> np.ndarray:
    """Input of the span classifier: kind and votes as indicators."""
    return np.array([1.0, *(kind == k for k in MORE), *(v == x for v in pattern for x in (-1, 1))], float)


def train(counts: dict[tuple[str, tuple[int, ...]], int]) -> np.ndarray:
    """Weights of the span classifier from counts of (kind, votes)."""
    merged: dict[tuple[int, ...], int] = {}
    for (_, pattern), c in counts.items():
        merged[pattern] = merged.get(pattern, 0) + c
    soft = reliabilities(dict(sorted(merged.items())))
    weights = np.zeros(len(features(MORE[0], (0,) * 6)))
    if not counts:
        weights[0] = -1.0
        return weights
    keys = sorted(counts)
    x = np.stack([features(k, p) for k, p in keys])
    y = np.array([soft[p] for _, p in keys])
    n = np.array([counts[k] for k in keys], float)
    n /= n.sum()
    for _ in range(STEPS):
        q = 1 / (1 + np.exp(-x @ weights))
        weights -= 1.0 * (x.T @ (n * (q - y)) + 1e-3 * weights)
    return weights


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Span classifier from the candidates of all documents."""

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            seen: dict[tuple, int] = {}
            for t in batch.column(0).to_pylist():
                if t:
                    for c in candidates(t, base_spans(t)):
                        key = (c[2], votes(t, c))
                        seen[key] = seen.get(key, 0) + 1
            return {"kind": [k for k, _ in seen], "votes": [list(v) for _, v in seen], "n": list(seen.values())}

        return run

    rows = (
        map_batches(docs.select(text_col), make, "kind string, votes array<int>, n bigint")
        .groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()  # at most 3 x 3^6 patterns
    )
    return train({(r.kind, tuple(r.votes)): r.n for r in rows})


@lru_cache(maxsize=1 << 12)
def accepted(kind: str, pattern: tuple[int, ...], weights: bytes) -> bool:
    """The classifier's decision: kinds and votes are few."""
    return float(features(kind, pattern) @ np.frombuffer(weights)) >= 0


def find(text: str | None, weights: np.ndarray) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    base, w = base_spans(text), weights.tobytes()
    more = [c for c in candidates(text, base) if accepted(c[2], votes(text, c), w)]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_email``, ``n_ip``, ``n_card``,
    ``n_phone``, ``base_sha256``, ``n_more``, ``spans``.

    Whole texts; null and empty texts have no spans; repeated rows give a
    row each; base spans of different kinds may overlap.
    """
    weights = fit(docs, text_col)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            found = [find(t, weights) for t in batch.column(1).to_pylist()]
            base = [[x for x in f if x[2] in BASE] for f in found]
            out = {id_col: batch.column(0), "spans": list(map(join_spans, found))}
            for k in BASE:
                out[f"n_{k}"] = [sum(x[2] == k for x in f) for f in found]
            return out | {
                "base_sha256": [sha256(join_spans(b).encode()).hexdigest() for b in base],
                "n_more": [len(f) - len(b) for f, b in zip(found, base)],
            }

        return run

    return map_batches(
        docs.select(id_col, text_col), make,
        f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "base_sha256 string, n_more bigint, spans string",
    )


def masked_column(text: Column | str, weights: np.ndarray) -> Column:
    """The text with every found span replaced by its kind (null: null)."""

    @F.arrow_udf("string")
    @trimmed
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            parts, at = [], 0
            for s, e, k in find(t, weights):
                if s >= at:
                    parts += [t[at:s], f"[{k}]"]
                at = max(at, e)
            out.append(t if t is None else "".join(parts) + t[at:])
        return pa.array(out, pa.string())

    return run(text)
