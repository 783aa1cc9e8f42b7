"""Secret scans: fixed patterns and a battery of randomness tests.

Fixed kinds are assignments, access keys and hexadecimal runs.  Beside
them every token of twelve signs and more is weighed: its encoding is
inferred from its alphabet; chi-squared uniformity over the alphabet, a
runs test about the alphabet's middle and the lag-one serial correlation
give p-values that the token is random, combined by Fisher's method; and
the likelihood ratio of "uniform over the alphabet" against "written by
a person" (who seldom changes between letters and digits) bounds its
p-value under the latter (Markov's inequality), which falls with length.
In tokens without digits a person's letters follow each other as in the
documents, whose pairs of letters are counted first: only so do words and
random letters differ.
Benjamini-Hochberg over the tokens of all documents turns these into
thresholds with a bounded share of false discoveries, one for each class
of length and letters, so that the many ordinary words do not raise that
of keys with digits.  The battery's p-values of the tokens found so go
through the same procedure by classes of length (its tests gain power
with length): those it rejects are no secrets, and of random tokens only
a bounded share is lost.  Passes count p-values in histograms of fixed
size, the last one decides.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import free, join_spans, map_batches, trimmed

# Patterns, shortest lengths and order of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "random")

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
DIGIT = re.compile(r"[0-9]")
#: Signs from which a token counts as long.
LONG = 16
ALPHABETS = (
    ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower26", "abcdefghijklmnopqrstuvwxyz"), ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
PLACES = {name: {c: i for i, c in enumerate(signs)} for name, signs in ALPHABETS}
#: Chance that a person's next sign is of another class than the last.
CHANGE = 0.1
#: False-discovery rates: of the battery's rejections of randomness, and
#: of the tokens found.
REJECT, FALSE_DISCOVERY = 0.001, 0.001
#: Classes of length: 8 to 15 signs, 16 to 31, ..., 1,024 and more.
LENGTHS = 8
#: Bins of the histogram, in bits of the p-value.
BITS = 256


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed kinds by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared (Wilson-Hilferty)."""
    c = 2 / (9 * k)
    return 0.5 * math.erfc(((x / k) ** (1 / 3) - (1 - c)) / math.sqrt(2 * c))


def battery(token: str, alphabet: str) -> float:
    """Combined p-value that the token is uniform over the alphabet."""
    place = PLACES[alphabet]
    v = np.array([place[c] for c in token], float)
    n, m = len(v), len(place)
    counts = np.bincount(v.astype(int), minlength=m)
    p1 = _chi_tail(float(((counts - n / m) ** 2).sum() * m / n), m - 1)
    high = v >= m / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p2 = 2.0 ** (1 - n)
    d = v - v.mean()
    s = float((d * d).sum())
    p3 = _normal_tail(float((d[1:] * d[:-1]).sum()) / s * math.sqrt(n)) if s else 2.0 ** (1 - n)
    x = -2 * sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return math.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2)  # chi-squared, 6 degrees


#: Log of the chance of a letter after another, a to z.
Letters = tuple[tuple[float, ...], ...]


def letter_surprise(token: str, signs: int, letters: Letters) -> float:
    """As ``surprise``, letters after letters by their chance."""
    size = {1: 26, 2: 26, 3: 4}
    kind = [1 if c.islower() else 2 if c.isupper() else 3 for c in token]
    bits = math.log2(size[kind[0]] * 3 / signs)
    low = token.lower()
    for i in range(1, len(token)):
        x, y = kind[i - 1], kind[i]
        bits -= math.log2(((1 - CHANGE) if x == y else CHANGE / 2) * signs)
        if x == 3 or y == 3:
            bits += math.log2(size[y])
        else:
            bits -= letters[ord(low[i - 1]) - 97][ord(low[i]) - 97]
    return bits


def length_class(token: str) -> int:
    """Class of a token's length."""
    return min(len(token).bit_length() - 4, LENGTHS - 1)


def rejection(token: str, alphabet: str) -> int:
    """Whole bits of the battery's p-value."""
    return min(BITS, int(-math.log2(max(battery(token, alphabet), 2.0**-BITS))))


def surprise(token: str, signs: int) -> float:
    """Bits of the likelihood ratio, random against written."""
    size = {0: 10, 1: 26, 2: 26, 3: 4}
    kind = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in token]
    bits = math.log2(size[kind[0]] * 4 / signs)
    for x, y in zip(kind, kind[1:]):
        p = (1 - CHANGE) if x == y else CHANGE / 3
        bits += math.log2(size[y] / p / signs)
    return bits


def stratum(token: str) -> int:
    """Class of a token: with digits or not, long or not."""
    return 2 * bool(DIGIT.search(token)) + (len(token) >= LONG)


def candidates(text: str, base: list[tuple[int, int, str]], letters: Letters) -> list[tuple[int, int, str, str, float]]:
    """Tokens outside the base spans: span, token, alphabet, bits."""
    out = []
    for s, e, whole in free([(s, e) for s, e, _ in base], ((*m.span(), m[0]) for m in TOKEN.finditer(text))):
        token = whole.rstrip("=")
        signs = set(token)
        alphabet = next(name for name, place in PLACES.items() if signs <= place.keys())
        size = len(PLACES[alphabet])
        bits = surprise(token, size) if DIGIT.search(token) else letter_surprise(token, size, letters)
        out.append((s, e, token, alphabet, bits))
    return out


def threshold(bins: dict[int, int], rate: float = FALSE_DISCOVERY) -> int:
    """Benjamini-Hochberg over binned bits: smallest bits to accept."""
    m = sum(bins.values())
    rank, best = 0, BITS + 1
    for b in sorted(bins, reverse=True):
        rank += bins[b]
        if b > 0 and 2.0**-b <= rate * rank / m:
            best = b
    return best


def pair_counts(text: str) -> np.ndarray:
    """Counts of the pairs of letters, 26 x 26, case left alone."""
    x = np.frombuffer(text.lower().encode("ascii", "replace"), np.uint8).astype(np.int64) - 97
    x = np.where((x < 0) | (x > 25), 26, x)
    return np.bincount(x[:-1] * 27 + x[1:], minlength=27 * 27).reshape(27, 27)[:26, :26]


def letter_chances(counts: np.ndarray) -> Letters:
    """Logs of chances from counts, one added to each."""
    c = counts + 1.0
    return tuple(map(tuple, np.log2(c / c.sum(1, keepdims=True)).tolist()))


def fit_letters(docs: DataFrame, text_col: str = "text") -> Letters:
    """Chances of letters after letters from all documents."""

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            n = sum((pair_counts(t) for t in batch.column(0).to_pylist() if t), np.zeros((26, 26), np.int64)).ravel()
            return {"pair": np.flatnonzero(n), "n": n[n > 0]}

        return run

    counts = np.zeros(26 * 26)
    rows = map_batches(docs.select(text_col), make, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most 26 x 26 rows
        counts[r.pair] = r.n
    return letter_chances(counts.reshape(26, 26))


@dataclass(frozen=True)
class Fitted:
    """Thresholds in bits by stratum, the chances of letters, and the
    battery's thresholds in bits by class of length."""

    least: tuple[int, ...]
    letters: Letters
    reject: tuple[int, ...]


def _histograms(docs: DataFrame, text_col: str, classes: int, of) -> list[dict[int, int]]:
    """Counts of whole bits by class; ``of`` gives (class, bits) of all
    tokens of a text."""

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            n = np.zeros(classes * (BITS + 1), np.int64)
            for t in batch.column(0).to_pylist():
                if t:
                    for k, bits in of(t):
                        n[k * (BITS + 1) + min(BITS, max(0, int(bits)))] += 1
            return {"bin": np.flatnonzero(n), "n": n[n > 0]}

        return run

    rows = map_batches(docs.select(text_col), make, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    bins: list[dict[int, int]] = [{} for _ in range(classes)]
    for r in rows.collect():  # at most classes x (BITS + 1) rows
        bins[r.bin // (BITS + 1)][r.bin % (BITS + 1)] = r.n
    return bins


def fit(docs: DataFrame, text_col: str = "text") -> Fitted:
    """Thresholds from the tokens of all documents."""
    letters = fit_letters(docs, text_col)
    least = tuple(map(threshold, _histograms(
        docs, text_col, 4, lambda t: ((stratum(x[2]), x[4]) for x in candidates(t, base_spans(t), letters))
    )))
    found = lambda t: (
        (length_class(x[2]), rejection(x[2], x[3]))
        for x in candidates(t, base_spans(t), letters) if int(x[4]) >= least[stratum(x[2])]
    )
    return Fitted(least, letters, tuple(threshold(b, REJECT) for b in _histograms(docs, text_col, LENGTHS, found)))


def find(text: str | None, fitted: Fitted | int) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind; a number is a threshold
    of all strata, with all letters alike."""
    if not text:
        return []
    if isinstance(fitted, int):
        fitted = Fitted((fitted,) * 4, letter_chances(np.zeros((26, 26))), (math.ceil(-math.log2(REJECT)),) * LENGTHS)
    by, letters = fitted.least, fitted.letters
    base = base_spans(text)
    more = [
        (s, e, "random") for s, e, token, alphabet, bits in candidates(text, base, letters)
        if int(bits) >= by[stratum(token)] and rejection(token, alphabet) < fitted.reject[length_class(token)]
    ]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256``, ``n_random``, ``spans``.

    Whole texts; null and empty texts have no spans; repeated rows give a
    row each; spans of different kinds may overlap.
    """
    fitted = fit(docs, text_col)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            found = [find(t, fitted) for t in batch.column(1).to_pylist()]
            base = [[x for x in f if x[2] != "random"] for f in found]
            out = {id_col: batch.column(0), "spans": list(map(join_spans, found))}
            for k in KINDS:
                out[f"n_{k}"] = [sum(x[2] == k for x in f) for f in found]
            return out | {"base_sha256": [sha256(join_spans(b).encode()).hexdigest() for b in base]}

        return run

    return map_batches(
        docs.select(id_col, text_col), make,
        f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, "
        "base_sha256 string, spans string",
    )


def masked_column(text: Column | str, fitted: Fitted | int, mask: str = "[secret]") -> Column:
    """The text with every found span replaced (null: null)."""

    @F.arrow_udf("string")
    @trimmed
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            spans = find(t, fitted)
            if spans:
                parts, at = [], 0
                for s, e, _ in spans:
                    if e > at:
                        if s >= at:
                            parts += [t[at:s], mask]
                        at = e
                t = "".join(parts) + t[at:]
            out.append(t)
        return pa.array(out, pa.string())

    return run(text)
