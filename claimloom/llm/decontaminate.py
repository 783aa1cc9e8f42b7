"""Benchmark decontamination by winnowing.

Words are hashed, five-word grams of them hashed again, and the smallest
gram hash of every six neighbouring grams is kept.  Ten words shared by
two texts hold six such grams in both, so both keep the same one: every
shared ten-word window shows up as a shared fingerprint.  Fingerprints
of the documents are joined with those of the benchmark; a hit is then
extended to every ten-word window around it, looked up by hash and
compared word by word.  Items under ten words have no such window: all
runs of their length are looked up instead.

The benchmark's index is broadcast only up to ``INDEX_WINDOWS`` distinct
windows; a larger benchmark is dealt into blocks of that size and the
documents take one pass for each, without a shuffle, carrying their hits
along.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import map_batches, trimmed

#: Words of a window and of a gram; grams of a window.
WINDOW, GRAM = 10, 5
GRAMS = WINDOW - GRAM + 1
#: Distinct windows of one broadcast index (about 200 bytes each).
INDEX_WINDOWS = 250_000
#: Bytes of text that are hashed at once (a longer text alone).
CHUNK = 1 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_WORD = np.array([0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=8)
def _powers(base: np.uint64, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out += hashes[i : i + m] * _powers(BASE, 10)[i + 1]
    return _mix(out)


class Words:
    """Words of some lower-cased texts in one buffer."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\0".join(texts) + b"\0"
        b = np.frombuffer(self.buffer, np.uint8)
        edge = np.flatnonzero(np.diff(IS_WORD[b], prepend=False))
        self.start, self.end = edge[::2], edge[1::2]
        bits = max(20, int(len(b)).bit_length())
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(BASE, bits)[: len(b)], out=sums[1:])
        self.hash = _mix((sums[self.end] - sums[self.start]) * _powers(BASE_INVERSE, bits)[self.start])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        #: first word of each text, and one past the last text's last
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(sizes)]))

    def text(self, at: int, n: int) -> bytes:
        """n words, space-joined."""
        s, e = self.start[at : at + n].tolist(), self.end[at : at + n].tolist()
        return b" ".join(self.buffer[i:j] for i, j in zip(s, e))

    def inside(self, at: np.ndarray, n: int) -> np.ndarray:
        """Those of the positions whose n words lie in one text."""
        at = at[(at >= 0) & (at + n <= len(self.hash))]
        text = np.searchsorted(self.first, at, side="right")
        return at[at + n <= self.first[text]]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Winnowed grams: word position and hash."""
        grams = runs(self.hash, GRAM)
        if len(grams) < GRAMS:
            return np.zeros(0, np.int64), grams[:0]
        starts = np.arange(len(grams) - GRAMS + 1)
        best = np.lib.stride_tricks.sliding_window_view(grams, GRAMS).argmin(1)
        ok = np.ones(len(starts), bool)
        for f in self.first[1:-1].tolist():  # windows across a border of texts
            ok[max(0, f - WINDOW + 1) : f] = False
        at = np.unique((starts + best)[ok])
        return at, grams[at]


class Index:
    """Windows of benchmark items, by hash."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        found: dict[bytes, set[str]] = defaultdict(set)
        prints = [np.zeros(0, np.uint64)]
        for item, text in items:
            w = Words([(text or "").encode().translate(LOWER)])
            n = len(w.hash)
            if n:
                size = min(n, WINDOW)
                for i in range(n - size + 1):
                    found[w.text(i, size)] |= {item} - {None}
                prints.append(w.fingerprints()[1])
        self.prints = np.unique(np.concatenate(prints))
        #: by number of words: sorted hashes, and windows and items by hash
        self.windows: dict[int, tuple[np.ndarray, dict[int, dict[bytes, list[str]]]]] = {}
        by_size: dict[int, dict[int, dict[bytes, list[str]]]] = defaultdict(lambda: defaultdict(dict))
        for window, ids in found.items():
            size = window.count(b" ") + 1
            by_size[size][int(runs(Words([window]).hash, size)[0])][window] = sorted(ids)
        for size, d in by_size.items():
            self.windows[size] = np.sort(np.fromiter(d, np.uint64, len(d))), dict(d)

    @staticmethod
    def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(x), bool)
        return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x

    def hits(self, w: Words) -> list[tuple[int, int, list[str]]]:
        """Verified windows in texts: word position, words, items."""
        out = []
        for size, (known, windows) in self.windows.items():
            if size == WINDOW:
                at, prints = w.fingerprints()
                at = at[self._among(prints, self.prints)]
                if not len(at):
                    continue
                at = np.unique((at[:, None] - np.arange(GRAMS)).ravel())  # extend each hit
            else:
                at = np.arange(len(w.hash))
            at = w.inside(at, size)
            if not len(at):
                continue
            hashes = np.zeros(len(at), np.uint64)
            for i in range(size):
                hashes += w.hash[at + i] * _powers(BASE, 10)[i + 1]
            hashes = _mix(hashes)
            keep = self._among(hashes, known)
            for p, h in zip(at[keep].tolist(), hashes[keep].tolist()):
                ids = windows[h].get(w.text(p, size))
                if ids is not None:
                    out.append((p, size, ids))
        return out


def scan(texts: list[str | None], index: Index) -> list[tuple[int, np.ndarray, set[str]]]:
    """Per text: number of words, positions of hit words, items."""
    out: list[tuple[int, np.ndarray, set[str]]] = []
    raw = [(x or "").encode().translate(LOWER) for x in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= CHUNK):
            size += len(raw[end])
            end += 1
        w = Words(raw[at:end])
        counts = np.diff(w.first).tolist()
        hit: dict[int, tuple[list[np.ndarray], set[str]]] = {}
        for p, n, ids in index.hits(w):
            k = int(np.searchsorted(w.first, p, side="right")) - 1
            spans, items = hit.setdefault(k, ([], set()))
            spans.append(np.arange(p, p + n) - w.first[k])
            items.update(ids)
        for k, n in enumerate(counts):
            spans, items = hit.get(k, ([], set()))
            out.append((n, np.unique(np.concatenate(spans)) if spans else np.zeros(0, np.int64), items))
        at = end
    return out


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list:
    """Broadcast indexes of the benchmark, each of bounded size.

    The number of words bounds the number of windows, so it decides how
    many blocks the items are dealt into.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    words = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    blocks = 1 + int(words) // INDEX_WINDOWS
    out = []
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        out.append(spark.sparkContext.broadcast(Index([(r.item, r.text) for r in part.toLocalIterator()])))
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: its hits against the benchmark's windows.

    Columns: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated``, ``items`` (sorted as strings) and ``spans`` (hit
    runs as ``first:end`` word positions, comma-joined).  Null text has
    no words; repeated rows and ids give a row each; an item without an
    id hits words but is not counted; an empty benchmark hits nothing.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    state = docs.select(id_col, text_col, F.lit(None).cast("binary").alias("hit"),
                        F.array().cast("array<string>").alias("items"))
    parts = indexes(benchmark)

    def one_pass(index, last: bool):
        def make():
            def run(batch: pa.RecordBatch) -> dict[str, list]:
                texts = batch.column(1).to_pylist()
                found = scan(texts, index.value)
                rows = []
                for (n, hit, items), was, had in zip(found, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if was:
                        hit = np.union1d(hit, np.frombuffer(was, np.int64))
                    rows.append((n, hit, sorted(items.union(had))))
                out = {id_col: batch.column(0), "items": [x[2] for x in rows]}
                if not last:
                    return out | {text_col: texts, "hit": [x[1].astype(np.int64).tobytes() for x in rows]}
                return out | {
                    "n_words": [x[0] for x in rows], "n_hit": [len(x[1]) for x in rows],
                    "n_items": [len(x[2]) for x in rows],
                    "items_sha256": [sha256(",".join(x[2]).encode()).hexdigest() for x in rows],
                    "contaminated": [len(x[1]) > 0 for x in rows],
                    "spans": [",".join(f"{r[0]}:{r[-1] + 1}" for r in np.split(x[1], np.flatnonzero(np.diff(x[1]) > 1) + 1) if len(r)) for x in rows],
                }

            return run

        return make

    for k, index in enumerate(parts):
        last = k == len(parts) - 1
        schema = f"`{id_col}` {kind}, " + (
            "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
            "items array<string>, spans string" if last else f"`{text_col}` string, hit binary, items array<string>"
        )
        state = map_batches(state, one_pass(index, last), schema)
    return state


def contaminated_column(text: Column | str, benchmark: DataFrame) -> Column:
    """Whether a text holds a benchmark window (null: no)."""
    def hit(index) -> Column:
        def has(texts: pa.Array) -> pa.Array:
            return pa.array([len(x[1]) > 0 for x in scan(texts.to_pylist(), index.value)], pa.bool_())

        return F.arrow_udf(trimmed(has), "boolean")(text)

    out = F.lit(False)
    for index in indexes(benchmark):
        out = out | hit(index)
    return out
