"""Exact top-k by inner product, term at a time.

Vectors become sparse integer rows: a term is a component, its weight
floor(64 * x).  Candidates are kept as postings, term by term: the rows
that hold the term and their weights (a term that most rows hold has a
weight for all).  For some queries of a block a dense score array
(queries x candidates) is filled posting by posting - each term scatters
candidate weight times query weight - and nothing is pruned, so scores
are exact.  Each query selects its best of the block (ties to the smaller
id), a task merges them from block to block, and a window over the parts'
selections merges those.

Rows are dealt evenly into a bounded number of parts and packed into
blocks of bounded size, whatever their ids; every block of queries meets
every block of candidates once, in the task of their two parts, which
returns at most k + 1 rows for each query.  Weights and sums are held in
as many bits as they need, up to Python integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import Scratch, bounded_batches

#: Candidates and queries in a block.
CANDIDATES, QUERIES = 8_192, 256
#: Parts of the candidates and of the queries at most; queries scored at once.
PARTS, GROUPS, TILE = 8, 256, 8
#: A weight is the floor of this many times a component.
FACTOR = 64.0


def quantise(vector: list[float | None] | None) -> list[int] | None:
    """Integer weights, or None where the vector takes no part."""
    if vector is None:
        return None
    out = []
    for x in vector:
        if x is None or not math.isfinite(x):
            return None
        out.append(_floor(float(x)))
    return out


def _floor(x: float) -> int:
    """floor(64 * x), exact where the product leaves the doubles, too."""
    y = FACTOR * x
    return math.floor(y) if math.isfinite(y) else int(x) * int(FACTOR)


def weights(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Weights of those rows that take part, and which these are; shorter
    rows end in zeros."""
    n = len(vectors)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0)).astype(np.int64)
    flat = np.asarray(pc.fill_null(vectors.flatten().cast(pa.float64()), math.nan))
    width = int(sizes.max()) if n else 0
    dense = np.zeros((n, width))
    inside = np.arange(width) < sizes[:, None]
    dense[inside] = flat
    use = np.asarray(vectors.is_valid()) & np.isfinite(dense).all(1)
    dense = dense[use]
    most = float(np.abs(dense).max()) if dense.size else 0.0
    if most * FACTOR < 2.0**62:
        out = np.floor(FACTOR * dense).astype(np.int64)
    else:
        out = np.array([_floor(x) for x in dense.ravel().tolist()], object).reshape(dense.shape)
    return out, np.flatnonzero(use)


def packed(rows: np.ndarray) -> tuple[str, int, bytes]:
    """Kind, width and bytes of a block's weights."""
    if rows.dtype != object:
        ends = [int(rows.min()), int(rows.max())] if rows.size else [0, 0]
        kind = next(x for x in ("int8", "int16", "int32", "int64") if all(np.iinfo(x).min <= e <= np.iinfo(x).max for e in ends))
        return kind, rows.shape[1], rows.astype(kind).tobytes()
    return "text", rows.shape[1], " ".join(map(str, rows.ravel().tolist())).encode()


def unpacked(kind: str, width: int, data: bytes, n: int) -> np.ndarray:
    """A block's weights."""
    if kind == "text":
        return np.array(list(map(int, data.split())), object).reshape(n, width)
    return np.frombuffer(data, kind).reshape(n, width)


class Candidates:
    """A block of candidates by id: per term the rows that hold it and
    their weights (all rows, where most do)."""

    def __init__(self, row: dict):
        ids = np.frombuffer(row["ids"], np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.dense = unpacked(row["kind"], row["width"], row["weights"], len(ids))[order]
        self.peaks = [_peak(self.dense[:, t]) for t in range(self.dense.shape[1])]
        self.made: dict[type, list[tuple[np.ndarray | None, np.ndarray]]] = {}

    def postings(self, kind: type) -> list[tuple[np.ndarray | None, np.ndarray]]:
        if kind not in self.made:
            self.made[kind] = out = []
            for t in range(self.dense.shape[1]):
                w = self.dense[:, t].astype(kind)
                at = np.flatnonzero(w)
                out.append((None, w) if 4 * len(at) > len(w) else (at, w[at]))
        return self.made[kind]


def _peak(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if len(x) else 0


def accumulate(queries: np.ndarray, candidates: Candidates) -> Iterator[tuple[int, np.ndarray]]:
    """Dense scores of a few queries at a time (number of the first,
    queries by candidates), in the smallest kind that no sum can leave;
    scores outside a long are held at its ends."""
    n, width = len(candidates.ids), min(queries.shape[1], candidates.dense.shape[1])
    bound = sum(_peak(queries[:, t]) * candidates.peaks[t] for t in range(width))
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    index = candidates.postings(kind)[:width]
    q = queries.astype(kind)
    product = np.empty((TILE, n), kind)
    for j in range(0, len(q), TILE):
        part = q[j : j + TILE]
        scores = np.zeros((len(part), n), kind)
        for t, (at, w) in enumerate(index):
            if at is None:
                scores += np.multiply(part[:, t, None], w, out=product[: len(part)])
            elif len(at):
                scores[:, at] += part[:, t, None] * w
        if kind is object:
            scores = np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)
        yield j, scores


class Best:
    """The best rows so far of a block of queries: of each the scores, ids
    and whether a row is the query's own, by score, then id."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, k: int):
        self.ids, self.weights, self.k = ids, weights, k
        none = np.zeros(0, np.int64)
        self.best = [(none, none, none.astype(bool))] * len(ids)

    def meet(self, candidates: Candidates) -> None:
        for first, scores in accumulate(self.weights, candidates):
            for j, (s, top) in enumerate(zip(scores, scores.max(1).tolist()), first):
                held = self.best[j][0]
                if len(held) < self.k or top >= held[-1]:
                    self._merge(j, s, candidates)

    def _merge(self, j: int, scores: np.ndarray, candidates: Candidates) -> None:
        held, ids, own = self.best[j]
        at = np.flatnonzero(scores >= held[-1]) if len(held) == self.k else np.arange(len(scores))
        at = at[select(scores[at], self.k)]
        same = candidates.ids[at] == self.ids[j]
        width = min(candidates.dense.shape[1], self.weights.shape[1])
        for i in np.flatnonzero(same).tolist():  # equal weights, too
            x, q = candidates.dense[at[i]], self.weights[j]
            same[i] = bool((x[:width] == q[:width]).all() and not x[width:].any() and not q[width:].any())
        s = np.concatenate([held, scores[at].astype(np.int64)])
        ids, own = np.concatenate([ids, candidates.ids[at]]), np.concatenate([own, same])
        order = np.lexsort((ids, ~s))  # the complement reverses the order of all longs
        self.best[j] = tuple(x[order[: self.k]] for x in (s, ids, own))

    def rows(self, block: int) -> pa.RecordBatch:
        n = np.fromiter((len(b[0]) for b in self.best), np.int64, len(self.best))
        number = np.repeat(np.arange(len(n)), n)
        scores, ids, own = (np.concatenate(x) for x in zip(*self.best))
        columns = [np.full(len(number), block), number, self.ids[number], ids, scores, own]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "number", "query_id", "vec_id", "score", "own"])


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best scores; the first rows of equal scores."""
    if len(scores) <= k:
        return np.arange(len(scores))
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > cut)
    return np.concatenate([above, np.flatnonzero(scores == cut)[: k - len(above)]])


def _blocks(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows dealt evenly to parts and packed: ids and weights of at most
    ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n = 0

        def block() -> pa.RecordBatch:
            nonlocal n
            width = max(w.shape[1] for w in held)
            wide = [np.pad(w, ((0, 0), (0, width - w.shape[1]))) for w in held]
            both, all_ids = np.concatenate(wide), np.concatenate(ids)
            ids[:], held[:] = [all_ids[size:]], [both[size:]]
            n = len(ids[0])
            kind, width, data = packed(both[:size])
            columns = [pa.array([all_ids[:size].tobytes()], pa.binary()), pa.array([data], pa.binary()),
                       pa.array([kind]), pa.array([width], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["ids", "weights", "kind", "width"])

        for b in batches:
            w, at = weights(b.column(1))
            ids.append(b.column(0).to_numpy()[at])
            held.append(w)
            n += len(at)
            while n >= size:
                yield block()
        if n:
            yield block()

    dealt = rows.where("id is not null").repartition(parts)
    return dealt.mapInArrow(run, "ids binary, weights binary, kind string, width int")


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k rows of ``vectors`` with the highest score for each query.

    Columns ``query_id, rank, vec_id, score``; ties go to the smaller
    id.  Rows whose id or vector is null, or whose vector holds null or
    a component that is not finite, take no part; missing components of
    shorter vectors count as zero; a score outside a long is held at its
    ends.  Of the candidates with a query's own id and weights one, its
    own row, is left out; other rows under its id count.  Repeated
    candidates count as often as they occur, and repeated queries give a
    result each.  No queries or no candidates: no rows.
    """
    spark = vectors.sparkSession
    q = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    c = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    n_queries, n = q.count(), c.count()
    bounded_batches(spark)
    # parts of both sides are few however many blocks there are: their pairs are tasks
    parts, groups = (max(1, min(most, -(-rows // size))) for most, rows, size in ((PARTS, n, CANDIDATES), (GROUPS, n_queries, QUERIES)))
    left = _blocks(c, CANDIDATES, parts)
    # written, so that a block's number does not depend on a retry
    asked = Scratch(spark).table(_blocks(q, QUERIES, groups).withColumn("block", F.monotonically_increasing_id()))
    right = asked.select("block", *(F.col(x).alias(f"q{x}") for x in ("ids", "weights", "kind", "width"))).repartition(groups)
    # partitions meet in pairs, blocks in the tasks: no pair of blocks is written, collected or broadcast
    pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Best] = {}
        data, candidates = None, None
        for b in batches:
            for row in b.to_pylist():
                if data != (row["ids"], row["weights"]):  # blocks of queries follow each other
                    data, candidates = (row["ids"], row["weights"]), Candidates(row)
                if row["block"] not in blocks:
                    ids = np.frombuffer(row["qids"], np.int64)
                    blocks[row["block"]] = Best(ids, unpacked(row["qkind"], row["qwidth"], row["qweights"], len(ids)), k + 1)
                blocks[row["block"]].meet(candidates)
        for block, best in blocks.items():
            yield best.rows(block)

    best = pairs.mapInArrow(run, "block bigint, number bigint, query_id bigint, vec_id bigint, score bigint, own boolean")
    # all candidates that equal the query have one score: the first of them is its own row
    by_score = [F.col("score").desc(), F.col("own").desc(), F.col("vec_id")]
    one = Window.partitionBy("block", "number")
    best = best.withColumn("place", F.row_number().over(one.orderBy(*by_score))).where(F.col("place") <= k + 1)
    best = best.withColumn("mine", F.min(F.when(F.col("own"), F.col("place"))).over(one)).where("mine is null or place <> mine")
    w = one.orderBy(F.col("score").desc(), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
