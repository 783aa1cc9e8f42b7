"""Toxicity of texts by a subword-bag classifier.

A word is the bag of its character n-grams (with marks at its ends) and
itself; each n-gram hashes to a row of an embedding table.  A word's
vector is the mean of its rows, a text's vector the mean over its
distinct words and a few blanks (so that a few words are weak evidence),
and a linear softmax reads it.  Embeddings and softmax are trained
jointly in numpy by gradient descent, so an unseen misspelling shares the vectors
of its n-grams.

Training runs in one task over a bounded sample of labelled rows, so a
lost executor costs a retry and the driver sees the folded model only.
Since everything after the table is linear, a trained model folds into
one number per row; a word's share of the logit is the mean over its
n-grams and a text's logit the mean over its words.  Scoring keeps a
bounded table of words in each task.  CRC-32 is linear over bits, so all
n-grams of many words are hashed at once from tables of code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from math import exp, fsum
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import trim

#: Labelled rows of each class that a model is trained on, at most; the
#: bound on what one task gathers.  Rows are taken in order of a hash.
ROWS_PER_CLASS = 2_500
#: Rows and width of the embedding table, n-gram lengths.  These and the
#: settings below were chosen by cross-validation over folds 1 to 4.
BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 17, 4, 3, 6
EPOCHS, BATCH, RATE, DECAY = 8, 32, 4.0, 1e-4
#: Texts an n-gram must be in; share of all n-grams at which its weight
#: halves; scale that brings a mean over a long text to unit size.
RARE, FREQUENT, SCALE = 4, 1e-4, 300.0
#: Blank words in every bag; power of the number of words that a bag is
#: divided by (a few words of a long text must not vanish), and the number
#: at which that equals the mean.
BLANKS, POWER, USUAL = 30, 0.5, 200


def _share(words: int) -> float:
    """What one of a text's words counts."""
    return 1 / ((words + BLANKS) ** POWER * USUAL ** (1 - POWER))

#: Words a task keeps; beyond it the older half goes.  Words above KEPT
#: letters are not kept but weighed each time.
TABLE_SIZE, KEPT = 100_000, 64
#: Letters whose n-grams are hashed at once (a longer word alone).
LETTERS = 1 << 18

_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """Distinct lower-cased words: a repeated line must not fill the bag."""
    return sorted(set(_words((text or "").lower())))


@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a letter at each place from the end of an n-gram adds to its
    CRC-32: by low 16 bits, by high bits; and the CRC of zeros by length."""
    def bits(place: int, first: int, n: int) -> np.ndarray:
        zero = crc32(bytes(4 * (place + 1)))
        out = np.zeros(1 << n, np.uint32)
        for i in range(n):
            one = crc32((1 << (first + i)).to_bytes(4, "little") + bytes(4 * place)) ^ zero
            out[1 << i : 2 << i] = out[: 1 << i] ^ np.uint32(one)
        return out

    places = range(LONGEST)
    return (
        np.stack([bits(p, 0, 16) for p in places]), np.stack([bits(p, 16, 5) for p in places]),
        np.array([crc32(bytes(4 * k)) for k in range(LONGEST + 1)], np.uint32),
    )


def rows_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of words - themselves and their n-grams, each row once a
    word - flat and in order, and how many each word has."""
    low, high, zeros = _crc_tables()
    rows, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(words):
        end, letters = at, 0
        while end < len(words) and (end == at or letters + len(words[end]) + 2 <= LETTERS):
            letters += len(words[end]) + 2
            end += 1
        marked = [f"<{w}>" for w in words[at:end]]
        n = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        left = np.repeat(np.cumsum(n), n) - np.arange(len(points))
        owner = np.repeat(np.arange(len(marked), dtype=np.int64), n)
        lows, highs = points & np.uint32(0xFFFF), points >> np.uint32(16)
        add = [low[p][lows] for p in range(LONGEST)]
        if highs.any():
            add = [x ^ high[p][highs] for p, x in enumerate(add)]
        parts = [np.flatnonzero(n > LONGEST) << 32 | np.fromiter(
            (crc32(m.encode("utf-32-le")) % BUCKETS for m in marked if len(m) > LONGEST), np.int64)]
        for k in range(SHORTEST, LONGEST + 1):
            m = len(points) - k + 1
            if m > 0:
                h = np.full(m, zeros[k])
                for j in range(k):
                    h ^= add[k - 1 - j][j : j + m]
                inside = left[:m] >= k
                parts.append(owner[:m][inside] << 32 | (h[inside] % np.uint32(BUCKETS)).astype(np.int64))
        both = np.sort(np.concatenate(parts))
        both = both[np.diff(both, prepend=-1) != 0]
        rows.append((both & 0xFFFFFFFF).astype(np.int32))
        sizes.append(np.bincount(both >> 32, minlength=len(marked)))
        at = end
    return np.concatenate(rows), np.concatenate(sizes)


def word_rows(word: str) -> list[int]:
    """Table rows of a word: itself and its n-grams, all of them."""
    return rows_of([word])[0].tolist()


class Model:
    """Folded model: a share of the logit per table row, and a bias."""

    def __init__(self, share: np.ndarray, bias: float):
        self.share, self.bias = share, bias
        self.table: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.share, self.bias)

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probabilities of label 1; without words that of the bias."""
        bags = [set(_words((t or "").lower())) for t in texts]
        new = sorted(set().union(*bags).difference(self.table))
        now = self.table
        if new:
            rows, sizes = rows_of(new)
            sums = np.add.reduceat(self.share[rows].astype(np.float64), np.cumsum(sizes) - sizes)
            values = (sums / sizes).tolist()
            if max(map(len, new)) > KEPT:
                now = self.table | dict(zip(new, values))
            self.table.update((w, x) for w, x in zip(new, values) if len(w) <= KEPT)
        if now is not self.table:
            get = now.__getitem__
        else:
            get = self.table.__getitem__
        out = []
        for bag in bags:
            z = self.bias + fsum(map(get, bag)) * _share(len(bag))
            out.append(1 / (1 + exp(-min(max(z, -30.0), 30.0))))
        if len(self.table) > TABLE_SIZE:
            for w in list(islice(self.table, len(self.table) - TABLE_SIZE // 2)):
                del self.table[w]
        return out

    def score(self, text: str | None) -> float:
        """Probability of label 1 of one text."""
        return self.scores([text])[0]


def _mass(words: np.ndarray, rows: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of a text and their shares of it, from its words."""
    n = sizes[words]
    at = np.repeat(ends[words] - np.cumsum(n), n) + np.arange(n.sum())
    mass = np.bincount(rows[at], np.repeat(_share(len(words)) / n, n), BUCKETS)
    some = np.flatnonzero(mass > 0)
    return some, mass[some]


def gradients(raw: np.ndarray, out: np.ndarray, base: np.ndarray, batch: tuple, scale: float) -> tuple:
    """Loss of a batch and its gradients by the batch's rows of the table
    (``scale * raw``), by the softmax' weights and by its offsets."""
    uniq, inverse, values, n, y, weight = batch
    x = np.add.reduceat(values[:, None] * (raw[uniq] * np.float32(scale))[inverse], np.cumsum(n) - n, axis=0)
    z = x @ out + base
    z = z - z.max(1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
    share = weight / weight.sum()
    loss = -float((share * log_p[np.arange(len(n)), y]).sum())
    g = np.exp(log_p)
    g[np.arange(len(n)), y] -= 1
    g *= share[:, None]
    gx = np.repeat((g @ out.T).astype(np.float32), n, axis=0) * values[:, None]
    rows = np.stack([np.bincount(inverse, gx[:, k], len(uniq)) for k in range(raw.shape[1])], axis=1)
    return loss, rows, x.T @ g, g.sum(0)


def train(texts: list[str | None], labels: list[int], weights: list[float] | None = None) -> Model:
    """Fit the model.  Without both labels the model is the constant prior."""
    y = np.asarray(labels, np.int64)
    weight = np.ones(len(y)) if weights is None else np.asarray(weights, np.float64)
    prior = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    bias = float(np.log(prior / (1 - prior)))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), bias)
    number: dict[str, int] = {}
    bags = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    rows, sizes = rows_of(list(number))
    del number
    ends = np.cumsum(sizes)
    # frequent n-grams count less (smooth inverse frequency); those of a
    # few texts can't generalise and stay zero
    texts_with, total = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS)
    for words in bags:
        if len(words):
            at, mass = _mass(words, rows, ends, sizes)
            texts_with[at] += 1
            total[at] += mass
    damp = np.where(texts_with >= RARE, FREQUENT / (FREQUENT + total / max(1, len(texts))), 0.0)
    rng = np.random.default_rng(0)
    raw = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.5, (WIDTH, 2))
    base = np.array([0.0, bias])
    batches = []
    order = rng.permutation(len(bags)).tolist()
    for first in range(0, len(order), BATCH):
        pick, found = [], []
        for i in order[first : first + BATCH]:
            if len(bags[i]):
                at, mass = _mass(bags[i], rows, ends, sizes)
                some = damp[at] > 0
                if some.any():
                    pick.append(i)
                    found.append((at[some], (mass * damp[at] * SCALE)[some]))
        if pick:
            uniq, inverse = np.unique(np.concatenate([a for a, _ in found]), return_inverse=True)
            values = np.concatenate([v for _, v in found]).astype(np.float32)
            n = np.fromiter((len(a) for a, _ in found), np.int64, len(found))
            batches.append((uniq.astype(np.int32), inverse.astype(np.int32), values, n, y[pick], weight[pick]))
    del bags, rows
    scale = 1.0  # decay of the whole table is one factor
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(batches)).tolist():
            _, by_rows, by_out, by_base = gradients(raw, out, base, batches[k], scale)
            out -= rate * 0.1 * by_out
            base -= rate * 0.1 * by_base
            scale *= 1 - rate * DECAY
            raw[batches[k][0]] -= (by_rows * (rate / scale)).astype(np.float32)
    fold = (out[:, 1] - out[:, 0]) * scale
    return Model(((raw @ fold) * damp * SCALE).astype(np.float32), float(base[1] - base[0]))


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """``id, text, y, weight`` of a bounded sample of labelled rows.

    At most ``rows_per_class`` ids of each class, smallest hash first, so
    the sample does not depend on partitions; of several texts under one
    id the first in order.  Weights give the classes shares as the square
    roots of their counts, between balance (too many false alarms) and
    the true shares (too many misses).
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    )
    totals = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    order = F.xxhash64(F.col("id").cast("string"))
    chosen = None
    for y in (0, 1):
        n = totals.get(y, 0)
        part = known.where(F.col("y") == y).orderBy(order, "id").limit(rows_per_class)
        part = part.withColumn("weight", F.lit(n**0.5 / max(1, min(n, rows_per_class))))
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 x rows_per_class ids are broadcast
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id").groupBy("id", "y", "weight").agg(F.min("text").alias("text"))
    )


def score_column(text: Column | str, model: Model, spark) -> Column:
    """Score of a text column under a model of fixed size."""
    share, bias = model.share, model.bias

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mine = Model(share, bias)  # its word table goes with the task
        for texts in batches:
            yield pa.array(mine.scores(texts.to_pylist()), pa.float64())
        del mine
        trim()

    return run(text)


def fold_of(id_col: Column | str) -> Column:
    """Fold 0 to 4 of an id: crc32 of its text, modulo 5 (null: fold 0)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 5, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Train on the labelled rows outside fold 0, in one task."""
    sample = sample_labelled(docs, labels.where(fold_of(id_col) != 0), id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys, weights = [], [], []
        for b in batches:
            for values, name in ((texts, "text"), (ys, "y"), (weights, "weight")):
                values += b.column(name).to_pylist()
        if texts:
            m = train(texts, ys, weights)
            yield pa.RecordBatch.from_arrays([pa.array([m.share.tobytes()], pa.binary()), pa.array([m.bias])], ["share", "bias"])

    rows = (
        sample.repartition(1).sortWithinPartitions("id", "text").select("text", "y", "weight")
        .mapInArrow(run, "share binary, bias double").collect()  # one row of fixed size
    )
    return Model(np.frombuffer(rows[0].share, np.float32), rows[0].bias) if rows else train([], [])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``score``, ``predicted``.

    Only labelled rows outside fold 0 train the model; the score sees the
    text alone.  Null and empty texts get the bias' score.  Ids labelled
    twice count once (label 1 wins), of several texts under one id the
    first in order is learnt from; null labels and labels other than 0
    and 1 are left out; without both labels every score is the prior.
    Repeated rows give a row each; other columns are left alone.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = docs.select(
        F.col(id_col), (fold_of(id_col) == 0).alias("held_out"),
        score_column(text_col, model, docs.sparkSession).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
