"""SimHash near-duplicates by Golay-code keys.

Fingerprints: 64 majority bits over the XXH64 hashes of word shingles.
Candidates: the 64 bits fall into three segments of 21, 21 and 22 bits,
each of two halves.  If two fingerprints differ in at most four bits,
some segment differs in at most two while two of the four halves of the
other segments do not differ at all (errors 3 and more in one segment
leave one for the rest; otherwise take the segment with the most, which
leaves at most two bad halves).  So each of 3 x 6 tables keys one
segment fuzzily and two halves exactly.  The fuzzy part uses the perfect
[23,12,7] Golay code: a word takes as keys the codewords within distance
four, at most six.  Two words at distance two have a word between them,
whose codeword lies within three of it and so within four of both: they
share a key.  Every shared key is verified by the bit count.

Groups: buckets are gathered per key for distinct fingerprints; within a
bucket a breadth-first walk over the bit counts links every fingerprint
to one that reached it, so a bucket of n gives fewer than n links, not
all pairs.  A bucket above ``TILE`` fingerprints is dealt into tiles and
every pair of tiles is walked, which keeps the work exact and each task
bounded.  Links then go to distributed connected components.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Scratch, components, key_counts, map_batches, salted_join, trimmed, written

#: Words of a shingle, hash seed and bits that may differ, by contract.
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Distinct fingerprints of one bucket that one task walks.
TILE = 16_384
#: Shingles whose hashes a worker holds at once.
CHUNK = 65_536

#: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Generator polynomial of the Golay code.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text; without words it is zero."""
    import xxhash

    if not text:
        return 0
    words = text.encode().translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return h(b" ".join(words), SEED)
    total = n - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = [0, *ends[: len(part) - SHINGLE].tolist()]
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts, stops)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column | str) -> Column:
    """Fingerprint of a text column as a signed long (null: zero)."""

    @F.arrow_udf("bigint")
    @trimmed
    def run(texts: pa.Array) -> pa.Array:
        out = np.array([fingerprint(x) for x in texts.to_pylist()], np.uint64)
        return pa.array(out.view(np.int64))

    return run(text)


@lru_cache(maxsize=1)
def syndromes() -> list[int]:
    """Remainder of each of the 23 bits by the generator."""
    out = []
    for bit in range(23):
        x = 1 << bit
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        out.append(x)
    return out


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each of 2048 syndromes: error patterns of weight four or less
    (-1 where there are fewer than six), and the syndromes of the low and
    of the high bits of words."""
    one = syndromes()
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for i in places:
                s ^= one[i]
            found[s].append(sum(1 << i for i in places))
    table = np.full((2048, 6), -1, np.int64)
    for s, patterns in enumerate(found):
        table[s, : len(patterns)] = patterns
    low = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ one[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ one[12 + i]
    return table, np.stack([low, np.pad(high, (0, len(low) - len(high)))])


def syndrome_of(words: np.ndarray) -> np.ndarray:
    """Syndromes of 23-bit words."""
    low, high = golay()[1]
    return low[words & 0xFFF] ^ high[words >> 12]


def segment_keys(words: np.ndarray) -> np.ndarray:
    """Codeword indices (upper 12 bits of the codeword) near each 23-bit
    word, six to a row, -1 where there are fewer."""
    errors = golay()[0][syndrome_of(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def table_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints: (row number, key), both flat."""
    parts = [(prints >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    rows, keys = [], []
    for g in range(3):
        fuzzy = segment_keys(parts[g])
        at, slot = np.nonzero(fuzzy >= 0)
        fuzzy = fuzzy[at, slot]
        halves = []
        for o in range(3):
            if o != g:
                n = SEGMENTS[o][1] // 2
                halves += [parts[o] & ((1 << n) - 1), parts[o] >> n]
        number = 0
        for i in range(4):
            for j in range(i):
                exact = halves[i] << 11 | halves[j]
                keys.append(((g * 6 + number) << 34 | fuzzy << 22 | exact[at]))
                rows.append(at)
                number += 1
    return np.concatenate(rows), np.concatenate(keys)


def walk(prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within ``distance``: a spanning
    forest, found breadth first against what is not reached yet."""
    left = np.arange(len(prints))
    a, b = [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue = [left[0]]
            left = left[1:]
        x = queue.pop()
        near = np.bitwise_count(prints[left] ^ prints[x]) <= distance
        if near.any():
            hit = left[near]
            a.append(np.full(len(hit), x))
            b.append(hit)
            queue.extend(hit.tolist())
            left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _key_rows(prints: DataFrame) -> DataFrame:
    def make():
        def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            p = batch.column(0).to_numpy().view(np.uint64)
            at, keys = table_keys(p)
            return {"key": keys, "print": p.view(np.int64)[at]}

        return run

    return map_batches(prints.select("print"), make, "key bigint, print bigint")


def _links(buckets: DataFrame) -> DataFrame:
    def make():
        def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            col = batch.column(0)
            ends = col.offsets.to_numpy()
            flat = col.values.to_numpy().view(np.uint64)
            out = [np.zeros((2, 0), np.int64)]
            for s, e in zip(ends[:-1], ends[1:]):
                p = flat[s:e]
                if e - s == 2:
                    if int(p[0] ^ p[1]).bit_count() <= DISTANCE:
                        out.append(p.view(np.int64).reshape(2, 1))
                else:
                    i, j = walk(p)
                    out.append(np.stack([p[i], p[j]]).view(np.int64))
            a, b = np.concatenate(out, axis=1)
            return {"a": np.minimum(a, b), "b": np.maximum(a, b)}

        return run

    return map_batches(buckets, make, "a bigint, b bigint").distinct()


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect distinct fingerprints ``print`` (long)
    exactly as all pairs within ``DISTANCE`` bits would."""
    keys = _key_rows(prints)
    hot = keys.groupBy("key").count().where(F.col("count") > TILE)
    # each hot key stands for more than TILE rows: few, but not bounded, so joined
    hot = written(hot.select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    if hot.isEmpty():
        buckets = keys.groupBy("key").agg(F.collect_set("print").alias("prints"))
        return _links(buckets.where(F.size("prints") > 1).select("prints"))
    cold = keys.join(hot, "key", "left_anti").groupBy("key").agg(F.collect_set("print").alias("prints"))
    tile = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")
    dealt = (
        keys.join(hot, "key").withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .groupBy("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
        .agg(F.collect_set("print").alias("prints"))
    )
    return _links(
        cold.where(F.size("prints") > 1).select("prints")
        .unionByName(dealt.where(F.size("prints") > 1).select("prints"))
    )


def print_components(own: DataFrame, scratch: Scratch) -> DataFrame:
    """``print, n, label, component_id`` of every distinct fingerprint,
    from rows ``id, print``: its number of rows, the component and the
    smallest id in it."""
    distinct = scratch.table(own.groupBy("print").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    labels = components(fingerprint_links(distinct))
    joined = scratch.table(
        distinct.join(labels, distinct["print"] == labels["node"], "left")
        .select("print", "first", "n", F.coalesce("label", "print").alias("label"))
    )
    small = joined.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    return scratch.table(
        salted_join(joined.drop("first"), small.select("label", "component_id"), "label", small, joined.count())
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``fingerprint`` (hex), ``component_id``.

    Whole texts; null and empty texts have fingerprint zero and are
    linked like any other.  Repeated rows give repeated results.  A null
    id is never a component's id, unless all of its ids are null.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.table(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col).alias("print")))
    found = print_components(own, scratch)
    return salted_join(own, found.select("print", "component_id"), "print", found.select("print", "n"), own.count()).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they are: the row with
    the smallest id (null ids last); of rows that share it, any one."""
    scratch = Scratch(docs.sparkSession)
    base = scratch.table(
        docs.select(
            F.struct("*").alias("doc"), F.col(id_col).alias("id"), fingerprint_column(text_col).alias("print"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    own = base.select("id", "print", "row")
    # rows of a fingerprint are combined before the shuffle
    first = own.groupBy("print").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    best = (
        first.join(print_components(own, scratch), "print").groupBy("label").agg(F.min("best").alias("best"))
        .select(F.col("best.row").alias("row"))
    )
    return base.join(best, "row", "left_semi").select("doc.*")
