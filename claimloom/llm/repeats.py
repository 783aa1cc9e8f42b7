"""Removal of repeated byte strings over prefix-free phrases.

Rolling-hash triggers cut the bytes of each document into phrases: in
every window of ``LENGTH`` bytes the trigger is the place of the smallest
rolling hash among its first ``SPREAD`` places, leftmost on ties, so it
depends on nothing but the window.  Windows that share a trigger form one
phrase context (from the first window's start to the last one's end), and
equal windows always share the ``LENGTH - SPREAD + 1`` bytes from their
trigger, the phrase's key.

1. Copies of whole texts are settled by their digest.
2. The dictionary: keys are counted over all documents; only phrases with
   a repeated key can hold a repeated window.
3. The parse: equal contexts - all but the first are repeated whole.
4. Where one key has several contexts (the ends of a repeat, edits), the
   first of each is one dictionary entry of a bucket of such keys.  The
   suffix array of the bucket's dictionary, combined with the places of
   its entries in the parse, orders the windows: neighbours that share
   ``LENGTH`` bytes are equal, and all but the first place of each group
   are repeated.  Equal windows have one key and so one bucket.
5. A key with more contexts than a bucket may hold is split by content:
   its windows go one by one to the partition of their 128-bit hash.

Only bounded sizes reach the driver or every executor: bitmaps
that tell which phrases to send, whose false hits cost rows but never
change results.  Tables and shuffle files go as soon as nothing reads
them any more.  Counts and firsts are aggregations, so a hot phrase is
combined before it is shuffled.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Scratch, collect_garbage, map_batches

#: Bytes of a repeated string; places a trigger may have in it; bytes of
#: the rolling hash.
LENGTH, SPREAD, ROLL = 100, 50, 16
#: Contexts of a bucket on average, and of one key in a bucket at most.
BUCKET, HOT = 2_000, 2_000
#: Bytes of text hashed at once (a longer text alone).
CHUNK = 1 << 18
#: log2 of the bits of a bitmap at most (32 MB).
BITMAP = 28

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def _id(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = _mix(h * np.uint64(BASES[0]) + p.astype(np.int64).view(np.uint64) + np.uint64(1))
    return h


class Chunk:
    """Some texts in one buffer, with hashes of any substring."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.n = n = len(self.bytes)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.bits = max(18, int(n + 1).bit_length())
        self._sums: dict[int, np.ndarray] = {}

    def sums(self, which: int) -> np.ndarray:
        """Prefix sums of the polynomial hash, made when first asked for."""
        if which not in self._sums:
            s = np.zeros(self.n + 1, np.uint64)
            values = self.bytes.astype(np.uint64)
            values += np.uint64(1)
            values *= _powers(BASES[which], self.bits)[: self.n]
            np.cumsum(values, out=s[1:])
            self._sums[which] = s
        return self._sums[which]

    def hash(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        inverse = _powers(pow(BASES[which], -1, 1 << 64), self.bits)
        s = self.sums(which)
        return _mix((s[end] - s[start]) * inverse[start] ^ (end - start).astype(np.uint64))

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts: text number, trigger, first and last window start."""
        m = self.n - LENGTH + 1
        none = np.zeros(0, np.int64)
        if m <= 0:
            return none, none, none, none
        s = self.sums(0)
        low = s[ROLL:] - s[:-ROLL]
        low *= _powers(pow(BASES[0], -1, 1 << 64), self.bits)[: len(low)]
        low ^= low >> np.uint64(32)
        low *= np.uint64(0xD6E8FEB86659FD93)
        low &= np.uint64(0xFFFFFFFF00000000)  # the hash above, the place below: leftmost on ties
        low |= np.arange(len(low), dtype=np.uint64)
        span = 1
        while span * 2 <= SPREAD:  # smallest of 2, 4, ... places
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = SPREAD - span
        low = np.minimum(low[: len(low) - rest], low[rest:])[:m]
        low &= np.uint64(0xFFFFFFFF)
        inside = np.ones(m, bool)
        for e in self.ends.tolist():  # windows across a border of texts
            inside[max(0, e - LENGTH + 1) : e] = False
        starts = np.flatnonzero(inside)
        if not len(starts):
            return none, none, none, none
        trigger = low[starts].view(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(trigger) != 0) | (np.diff(starts) != 1)]))
        last = np.concatenate([new[1:], [len(starts)]]) - 1
        return np.searchsorted(self.ends, starts[new], side="right"), trigger[new], starts[new], starts[last]


def chunks(texts: list[str | None]):
    """Chunks of whole texts: (number of the first text, texts, chunk)."""
    raw = [(x or "").encode() for x in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= CHUNK):
            size += len(raw[end])
            end += 1
        yield at, raw[at:end], Chunk(raw[at:end])
        at = end


def _bitmap(rows: DataFrame, col: str, count: int):
    """Broadcast bitmap over a column of ``count`` hashes: two bits for
    each, of as many that few are set, up to ``BITMAP``."""
    bits = min(BITMAP, max(12, (64 * count).bit_length()))
    words = (
        rows.select(F.explode(F.array(F.col(col), F.shiftrightunsigned(col, 32))).alias("h"))
        .groupBy(F.expr(f"shiftright(h, 6) & {(1 << (bits - 6)) - 1}").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return rows.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes have both bits."""

    def has(x: np.ndarray) -> np.ndarray:
        word = bitmap[(x >> np.uint64(6) & np.uint64(len(bitmap) - 1)).astype(np.int64)]
        return (word >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)

    out = has(h)
    some = np.flatnonzero(out)
    out[some] = has(h[some] >> np.uint64(32))
    return out


def _key_counts(docs: DataFrame) -> DataFrame:
    def make():
        def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            parts = [np.zeros(0, np.uint64)]
            for _, _, c in chunks(batch.column(2).to_pylist()):
                _, t, _, _ = c.phrases()
                parts.append(c.hash(t, t + LENGTH - SPREAD + 1, 0))
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            return {"key": keys.view(np.int64), "n": n}

        return run

    return map_batches(docs, make, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _contexts(docs: DataFrame, repeated) -> DataFrame:
    def make():
        def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: dict[str, list] = {k: [] for k in ("key", "content", "id", "tie", "lo", "more")}
            for first, raw, c in chunks(batch.column(2).to_pylist()):
                text, t, lo, hi = c.phrases()
                key = c.hash(t, t + LENGTH - SPREAD + 1, 0)
                keep = _in(repeated.value, key)
                text, lo, hi = text[keep], lo[keep], hi[keep]
                begin = c.ends[text] - np.fromiter(map(len, raw), np.int64, len(raw))[text]
                i, tie = ids[first + text], ties[first + text]
                out["key"].append(key[keep].view(np.int64))
                out["content"].append(c.hash(lo, hi + LENGTH, 1).view(np.int64))
                out["id"].append(i)
                out["tie"].append(tie)
                out["lo"].append(lo - begin)
                out["more"].append(hi - lo)
            return {k: np.concatenate(v) for k, v in out.items()}

        return run

    return map_batches(
        docs, make, "key bigint, content bigint, id bigint, tie bigint, lo bigint, more bigint"
    )


def _bodies(docs: DataFrame, marked) -> DataFrame:
    """Bytes of the marked contexts (and of a few others)."""
    def make():
        def run(batch: pa.RecordBatch) -> dict[str, object]:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in ("key", "id", "tie", "lo")}
            body: list[bytes] = []
            for first, raw, c in chunks(batch.column(2).to_pylist()):
                text, t, lo, hi = c.phrases()
                begin = c.ends[text] - np.fromiter(map(len, raw), np.int64, len(raw))[text]
                i, tie = ids[first + text], ties[first + text]
                keep = _in(marked.value, _id(i, tie, lo - begin))
                out["key"].append(c.hash(t[keep], t[keep] + LENGTH - SPREAD + 1, 0).view(np.int64))
                out["id"].append(i[keep])
                out["tie"].append(tie[keep])
                out["lo"].append((lo - begin)[keep])
                for k, s, e in zip(text[keep].tolist(), (lo - begin)[keep].tolist(), (hi - begin)[keep].tolist()):
                    body.append(raw[k][s : e + LENGTH])
            return {k: np.concatenate(v) for k, v in out.items()} | {"body": body}

        return run

    return map_batches(docs, make, "key bigint, id bigint, tie bigint, lo bigint, body binary")


def suffix_array(dictionary: list[bytes], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the entries in the order of their first ``depth``
    bytes, by prefix doubling: (order, rank by position, entry starts);
    positions count through the joined entries, and suffixes with equal
    first bytes have equal ranks."""
    sizes = np.fromiter(map(len, dictionary), np.int64, len(dictionary))
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # bytes up to the entry's end
    rank = np.frombuffer(b"".join(dictionary), np.uint8).astype(np.int64) + 1
    known = 1
    while known < depth:
        step = min(known, depth - known)
        then = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > step)
        then[inside] = rank[inside + step]
        rank = np.unique(rank * (n + 257) + then, return_inverse=True)[1] + 1
        known += step
    return np.argsort(rank, kind="stable"), rank, starts


def repeated_windows(bodies: list[bytes], places: np.ndarray) -> np.ndarray:
    """Places of windows that also start at a smaller place.

    ``places`` holds (id, tie, start) of every body.  The dictionary is
    the distinct bodies; the parse lists its entries' places.
    """
    order = np.lexsort(places.T[::-1])
    dictionary = sorted(set(bodies))
    number = {b: k for k, b in enumerate(dictionary)}
    _, rank, starts = suffix_array(dictionary)
    entry = np.fromiter((number[b] for b in bodies), np.int64, len(bodies))[order]
    n = np.fromiter(map(len, dictionary), np.int64, len(dictionary))[entry] - LENGTH + 1
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    group = rank[np.repeat(starts[entry], n) + offset]
    where = places[order][np.repeat(np.arange(len(order)), n)]
    where = where + np.stack([np.zeros_like(offset), np.zeros_like(offset), offset], axis=1)
    by = np.lexsort((where[:, 2], where[:, 1], where[:, 0], group))
    same = group[by][1:] == group[by][:-1]
    later = (where[by][1:] != where[by][:-1]).any(axis=1)
    # a place that equals its predecessor's repeats only if that one does
    out = np.zeros(len(by), bool)
    out[1:] = same & later
    run = np.flatnonzero(same & ~later) + 1
    for k in run.tolist():
        out[k] = out[k - 1]
    return where[by][out]


def _by_suffixes(bodies: DataFrame, buckets: int) -> DataFrame:
    gathered = bodies.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).agg(
        F.collect_list("body").alias("body"), F.collect_list("id").alias("id"), F.collect_list("tie").alias("tie"),
        F.collect_list("lo").alias("lo"),
    )

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            out = [np.zeros((0, 3), np.int64)]
            for row in batch.to_pylist():
                places = np.array([row["id"], row["tie"], row["lo"]], np.int64).T
                out.append(repeated_windows(row["body"], places))
            i, tie, lo = np.concatenate(out).T
            return {"id": i, "tie": tie, "lo": lo}

        return run

    return map_batches(gathered.select("body", "id", "tie", "lo"), make, "id bigint, tie bigint, lo bigint")


def _windows(bodies: DataFrame) -> DataFrame:
    """Windows of bodies by the hash of their bytes."""
    def make():
        def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            raw = batch.column("body").to_pylist()
            c = Chunk(raw)
            n = np.fromiter(map(len, raw), np.int64, len(raw)) - LENGTH + 1
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(c.ends - n - LENGTH + 1, n) + offset
            return {
                "w1": c.hash(start, start + LENGTH, 0).view(np.int64), "w2": c.hash(start, start + LENGTH, 1).view(np.int64),
                "id": np.repeat(batch.column("id").to_numpy(), n), "tie": np.repeat(batch.column("tie").to_numpy(), n),
                "lo": np.repeat(batch.column("lo").to_numpy(), n) + offset,
            }

        return run

    return map_batches(bodies.select("id", "tie", "lo", "body"), make, "w1 bigint, w2 bigint, id bigint, tie bigint, lo bigint")


def _later(rows: DataFrame, keys: list[str], firsts: DataFrame) -> DataFrame:
    """Rows that come after the first row of their keys."""
    return rows.join(firsts, keys).where(
        F.struct("id", "tie", "lo") > F.struct(F.col("first.id"), F.col("first.tie"), F.col("first.lo"))
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: what is left without repeated strings.

    Every byte covered by a ``LENGTH``-byte string that also starts
    earlier (smaller id, or the same text at an earlier place) goes.
    Columns: id (long), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs), ``kept_sha256``.  Null text is empty; texts below
    ``LENGTH`` bytes stay whole; null ids come before all others; rows
    equal in id and text are one document and get equal results; of rows
    with one id and different texts, that of the smaller digest is first.
    """
    base = docs.select(
        F.col(id_col).cast("bigint").alias("key_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("id"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    ).withColumn("sha", F.sha2("text", 256))
    base = base.withColumn("tie", F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint"))
    firsts = base.groupBy("sha").agg(F.min("id").alias("first_id"))
    scratch = Scratch(docs.sparkSession)

    def table(rows: DataFrame) -> DataFrame:
        out = scratch.table(rows)
        collect_garbage(docs.sparkSession)
        return out

    copies = table(
        base.select("id", "tie", "sha").join(firsts, "sha").where(F.col("id") > F.col("first_id"))
        .select("id", "tie").distinct().select("id", "tie", _python_id("id", "tie").alias("mark"))
    )
    own = _bitmap(copies, "mark", copies.count())
    # texts that may be copies by the bitmap are looked up exactly, the others go on at once
    flat = base.select("id", "tie", "text")
    maybe = _marked(flat, own)
    unique = maybe.where("not hit").select("id", "tie", "text").unionByName(
        maybe.where("hit").select("id", "tie", "text").join(copies.select("id", "tie"), ["id", "tie"], "left_anti")
    )
    keys = table(_key_counts(unique).where("n > 1").select("key"))
    repeated = _bitmap(keys, "key", keys.count())
    scratch.drop(keys)
    # key and content together are a context's hash of 128 bits
    contexts = table(_contexts(unique, repeated))
    classes = contexts.groupBy("key", "content").agg(F.min(F.struct("id", "tie", "lo")).alias("first"))
    several = table(classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    total, most, n_several = several.agg(F.sum("n"), F.max("n"), F.count("*")).first()
    # by a bitmap, not a join: a false hit only adds a context that is there
    edges = _marked(classes, _bitmap(several, "key", n_several), "key", hashed=True).where("hit").select(
        _python_id("first.id", "first.tie", "first.lo").alias("mark")
    )
    marked = _bitmap(edges, "mark", total or 0)
    whole = _later(contexts, ["key", "content"], classes).select(
        "id", "tie", "lo", (F.col("lo") + F.col("more") + LENGTH).alias("to")
    )
    bodies = table(_bodies(unique, marked))
    hot = several.where(F.col("n") > HOT).select("key")
    split = (most or 0) > HOT
    cold = bodies.join(hot, "key", "left_anti") if split else bodies
    single = _by_suffixes(cold, 1 + (total or 0) // BUCKET)
    windows = None
    if split:
        windows = table(_windows(bodies.join(hot, "key", "left_semi")))
        first = windows.groupBy("w1", "w2").agg(
            F.min(F.struct("id", "tie", "lo")).alias("first"), F.count("*").alias("n")
        )
        single = single.unionByName(
            _later(windows, ["w1", "w2"], first.where("n > 1").drop("n")).select("id", "tie", "lo")
        )
    single = single.select("id", "tie", "lo", (F.col("lo") + LENGTH).alias("to"))
    covers = table(
        whole.unionByName(single).groupBy("id", "tie").agg(F.collect_list(F.struct("lo", "to")).alias("spans"))
        .unionByName(copies.select("id", "tie", F.lit(None).cast("array<struct<lo:bigint,to:bigint>>").alias("spans")))
        .withColumn("mark", _python_id("id", "tie"))
    )
    scratch.drop(*(x for x in (copies, contexts, several, bodies, windows) if x is not None))
    touched = _bitmap(covers, "mark", covers.count())
    final = _marked(base.select("id", "tie", "text", "key_id"), touched)
    left = final.where("not hit").select("key_id", "text", F.lit(False).alias("copy"),
                                         F.lit(None).cast("array<struct<lo:bigint,to:bigint>>").alias("spans"))
    right = (
        final.where("hit").select("id", "tie", "key_id", "text")
        .join(covers.withColumn("has", F.lit(True)), ["id", "tie"], "left")
        .select("key_id", "text", (F.col("has").isNotNull() & F.col("spans").isNull()).alias("copy"), "spans")
    )

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for text, copy, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                b = text.encode()
                n, removed, runs, kept = len(b), 0, 0, b
                if copy and n >= LENGTH:
                    removed, runs, kept = n, 1, b""
                elif spans:
                    parts, at = [], 0
                    end = -1
                    for s, e in sorted((x["lo"], x["to"]) for x in spans):
                        if s > end:
                            runs += 1
                            parts.append(b[at:s])
                        removed += max(0, e - max(s, end))
                        end = at = max(end, e)
                    kept = b"".join(parts) + b[at:]
                out["n_bytes"].append(n)
                out["n_removed"].append(removed)
                out["n_spans"].append(runs)
                out["kept_sha256"].append(sha256(kept).hexdigest())
            return {id_col: batch.column(0)} | out

        return run

    return map_batches(
        left.unionByName(right), make, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def _python_id(*cols: str):
    """The hash of ``_id`` as a column, of two or three longs."""

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_id(a.to_numpy(), b.to_numpy()).view(np.int64))

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array(_id(a.to_numpy(), b.to_numpy(), c.to_numpy()).view(np.int64))

    return F.arrow_udf(two if len(cols) == 2 else three, "bigint")(*cols)


def _marked(rows: DataFrame, bitmap, *cols: str, hashed: bool = False) -> DataFrame:
    """Rows with ``hit``: whether the bitmap has the hash of ``id, tie``
    or, where ``hashed``, of a column that is a hash itself."""

    def pair(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_in(bitmap.value, _id(a.to_numpy(), b.to_numpy())), pa.bool_())

    def one(a: pa.Array) -> pa.Array:
        return pa.array(_in(bitmap.value, a.to_numpy().view(np.uint64)), pa.bool_())

    return rows.withColumn("hit", F.arrow_udf(one if hashed else pair, "boolean")(*(cols or ("id", "tie"))))
