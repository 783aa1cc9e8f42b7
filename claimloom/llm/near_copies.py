"""SimHash near copies at a Jaccard similarity of word shingles.

The general form of ``simhash``: shingles of five words, texts linked at
a Jaccard similarity of 0.8 or more of their shingle sets.  At 0.8 some
15 % of the bits of two fingerprints differ, so fixed radii of a few bits
reach nothing and the Golay code is used with soft decisions: twelve
segments of 23 bits are each decoded to the four codewords nearest to
them where a bit weighs as much as its majority.  The bits that differ
are nearly always those of small majorities, so two near copies share a codeword in
85 % of the segments at 0.8.  Keys join the codewords of two segments,
the twelve best combinations of each of six pairs that have no segment in
common: 72 keys.  Simulated with 200 shingles a text, 12 of 2,000 pairs
at 0.8 share no key, 1 at 0.85 and none at 0.9.
Keys also hold the power of two below a size; a size whose 5/4 passes the
next power has its keys there, too, so sizes that allow 0.8 always share
one.
Rows of keys carry 64 bits of the fingerprint, so most candidates are
rejected where they meet, before any shuffle: a bucket of two by the
exclusive or of its members' bits.  The others are filtered by the whole
fingerprint and by a bitmap of the hashes that occur (which bounds the shingles that differ from below, so
it is exact), then verified on the texts' whole shingle sets.

Equal sets are one node.  First the buckets of one pair of segments link
their members to a centre; each node is verified against the candidate
with the nearest fingerprint, then pairs that would still join two groups
are.  After that only buckets with members of several groups count, in
all pairs of segments: each gets a centre of its largest group, small
ones are compared pair by pair, and in larger ones that still have
several groups all pairs of members of different groups that the
sketches allow.  So a large group of near copies takes rows in
proportion to its size, and no candidate that could join two groups is
left out.

A random pair of like sizes shares a key with a chance of 1 in 19,000:
comparisons of 64 bits within buckets grow with the square of the corpus,
rows that leave them by a 250th of that.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Bitmap, Scratch, collect_garbage, components, key_counts, map_batches, salted_join, trimmed
from claimloom.llm.simhash import LOWER, syndrome_of, syndromes

#: Words of a shingle; similarity NUMERATOR / DENOMINATOR.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Words of hash bits; bits of a segment, two of which lie in a word.
HASHES, BITS = 6, 23
SEGMENTS = 2 * HASHES
#: Codewords of a segment; segments of a key, and keys of each choice.
NEAREST, JOINED, COMBINATIONS = 4, 2, 12
#: Keys of a text in one class of sizes.
KEYS = SEGMENTS // JOINED * COMBINATIONS
#: Bits of a key that hold the class of a size.
CLASS = 6
#: Words whose bits are the fingerprint, and bits of it that may differ:
#: 21 are expected at 0.8, with a deviation of 4.
WORDS, FAR = 3, 38
#: The same of the 64 bits that rows of keys carry: 10, deviation 3.
FAR_SHORT = 21
#: Words of 64 marks: bits of the hashes that occur.  Marks of two sets
#: that differ are no more than the shingles that do.
MARKS = 16
INFO = ("size", *(f"f{k}" for k in range(WORDS)), *(f"m{k}" for k in range(MARKS)))
#: Members of a bucket that are compared pair by pair at once.
SMALL = 16
#: Rounds of centres before larger buckets are compared in full.
STARS = 1
#: Shingles of texts that a worker keeps while it verifies.
KEPT = 1_000_000
#: Odd factors that make HASHES words of a shingle's hash.
MULTIPLIERS = tuple(0x9E3779B97F4A7C15 * (2 * k + 1) ** 5 & (1 << 64) - 1 for k in range(HASHES))
#: Blocks of 255 shingles, and rows of segments, that are worked on at once.
BLOCKS, ROWS = 128, 4_096


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; shorter texts are one."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([h(b" ".join(words))], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    return np.unique(np.fromiter((h(joined[s:e]) for s, e in zip(starts, stops)), np.uint64, len(stops)))


@lru_cache(maxsize=1)
def _lanes() -> np.ndarray:
    """A byte's bits, each in a byte of its own."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8")[:, 0]


def majorities(sets: list[np.ndarray]) -> np.ndarray:
    """Ones less zeros: sets (none empty) x segments x bits.

    Counts run in byte lanes over blocks of 255 shingles.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    counts = np.zeros((len(starts), HASHES * 48), np.int32)
    for at in range(0, len(starts), BLOCKS):
        s = starts[at : at + BLOCKS]
        end = starts[at + BLOCKS] if at + BLOCKS < len(starts) else len(flat)
        h = flat[s[0] : end]
        x = np.stack([h * np.uint64(m) for m in MULTIPLIERS], axis=1)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        by = x.view(np.uint8).reshape(len(h), HASHES, 8)[:, :, :6].reshape(len(h), -1)
        total = np.add.reduceat(_lanes()[by], s - s[0], axis=0)
        counts[at : at + BLOCKS] = total.view(np.uint8)
    ones = np.add.reduceat(counts, first, axis=0).reshape(len(sets), HASHES, 48)[:, :, : 2 * BITS]
    return (2 * ones - sizes[:, None, None]).reshape(len(sets), SEGMENTS, BITS)


@lru_cache(maxsize=1)
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: error patterns of weight five and less, as integers
    and as places (BITS where there are fewer); no pattern is -1."""
    one = syndromes()
    found: list[list[tuple[int, ...]]] = [[] for _ in range(2048)]
    for k in range(6):
        for places in combinations(range(BITS), k):
            s = 0
            for i in places:
                s ^= one[i]
            found[s].append(places)
    most = max(map(len, found))
    number = np.full((2048, most), -1, np.int32)
    at = np.full((2048, most, 5), BITS, np.int8)
    for s, rows in enumerate(found):
        for k, places in enumerate(rows):
            number[s, k] = sum(1 << i for i in places)
            at[s, k, : len(places)] = places
    return number, at


def decode(major: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codewords of segments (rows x BITS): their indices and the
    majorities that stand against them, NEAREST of each."""
    number, places = _patterns()
    words = (major > 0) @ (1 << np.arange(BITS))
    weight = np.zeros((len(major), BITS + 1), np.int64)
    weight[:, :BITS] = np.abs(major)
    codes = np.zeros((len(major), NEAREST), np.int64)
    costs = np.zeros((len(major), NEAREST), np.int64)
    for at in range(0, len(major), ROWS):
        w = words[at : at + ROWS]
        s = syndrome_of(w)
        rows = np.arange(len(w))[:, None]
        cost = weight[at : at + ROWS][rows[:, :, None], places[s]].sum(2)
        cost[number[s] < 0] = 1 << 40
        best = np.argsort(cost, axis=1, kind="stable")[:, :NEAREST]
        codes[at : at + ROWS] = (w[:, None] ^ number[s][rows, best]) >> 11
        costs[at : at + ROWS] = cost[rows, best]
    return codes, costs


def classes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of sizes (floor of the logarithm to base two) and of the
    largest sizes that similar sets can have: the same or the next."""
    power = lambda n: np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1
    return power(sizes), power(sizes.astype(np.int64) * DENOMINATOR // NUMERATOR)


def keys_of(codes: np.ndarray, costs: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Keys of texts (texts x SEGMENTS x NEAREST) in classes of sizes: the
    cheapest choices of a codeword in each of JOINED segments, which no
    other choice uses."""
    out = []
    for number in range(SEGMENTS // JOINED):
        key = number << CLASS | power[:, None]
        cost = np.zeros((len(codes), 1), np.int64)
        for g in range(JOINED * number, JOINED * (number + 1)):
            key = (key[:, :, None] << 12 | codes[:, g, None, :]).reshape(len(codes), -1)
            cost = (cost[:, :, None] + costs[:, g, None, :]).reshape(len(codes), -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :COMBINATIONS]
        out.append(np.take_along_axis(key, best, 1))
    return np.concatenate(out, axis=1)


def marks_of(sets: list[np.ndarray]) -> np.ndarray:
    """Marks of sets, MARKS words of each."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    seen = np.zeros((len(sets), 64 * MARKS), bool)
    at = (np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(40)) % np.uint64(64 * MARKS)
    seen[np.repeat(np.arange(len(sets)), sizes), at.astype(np.int64)] = True
    return np.packbits(seen, axis=1, bitorder="little").view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are near copies."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (len(a) + len(b))


def _sketch(text: Column | str) -> Column:
    """Struct of the set's 128-bit digest and size, the fingerprint in
    words, marks, and codewords with costs (none if the set is
    empty)."""
    longs = ", ".join(f"{c} bigint" for c in INFO[1:])

    @F.arrow_udf(f"k1 bigint, k2 bigint, size int, {longs}, codes array<int>")
    @trimmed
    def run(texts: pa.Array) -> pa.Array:
        import xxhash

        sets = [shingle_set(t) for t in texts.to_pylist()]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        full = [k for k, s in enumerate(sets) if len(s)]
        marks = marks_of(sets)
        prints = np.zeros((len(sets), WORDS), np.int64)
        packed = np.zeros((0, SEGMENTS * NEAREST), np.int32)
        if full:
            major = majorities([sets[k] for k in full])
            prints[full] = (major[:, : 2 * WORDS] > 0).reshape(len(full), WORDS, 2 * BITS) @ (1 << np.arange(2 * BITS))
            codes, costs = decode(major.reshape(-1, BITS))
            packed = (np.minimum(costs, (1 << 19) - 1) << 12 | codes).astype(np.int32).reshape(len(full), -1)
        counts = np.zeros(len(sets), np.int32)
        counts[full] = packed.shape[1]
        return pa.StructArray.from_arrays(
            [pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1])),
             pa.array(list(map(len, sets)), pa.int32()), *(pa.array(np.ascontiguousarray(prints[:, k])) for k in range(WORDS)),
             *(pa.array(np.ascontiguousarray(marks[:, k])) for k in range(MARKS)),
             pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(packed.ravel()))],
            ["k1", "k2", *INFO, "codes"],
        )

    return run(text)


def _key_rows(nodes: DataFrame) -> DataFrame:
    """``key, node, short`` of all keys, with 64 bits of the fingerprint
    from segments that the key does not hold."""

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            packed = np.asarray(batch.column(1).flatten()).astype(np.int64).reshape(-1, SEGMENTS, NEAREST)
            low, high = classes(batch.column(2).to_numpy())
            f = [batch.column(3 + k).to_numpy() for k in range(WORDS)]
            # a key's members agree in the bits that it comes from: others tell them apart
            short = np.stack([a | b << 2 * BITS for a, b in ((f[1], f[2]), (f[0], f[2]), *[(f[0], f[1])] * (HASHES - 2))], 1)
            rows = np.concatenate([np.arange(len(low)), np.flatnonzero(high > low)])
            packed = packed[rows]
            keys = keys_of(packed & 4095, packed >> 12, np.concatenate([low, high[high > low]]))
            node = np.repeat(batch.column(0).to_numpy()[rows], keys.shape[1])
            return {"key": keys.ravel(), "node": node, "short": np.repeat(short[rows], COMBINATIONS, axis=1).ravel()}

        return run

    rows = nodes.where("size > 0").select("node", "codes", "size", *(f"f{k}" for k in range(WORDS)))
    return map_batches(rows, make, "key bigint, node bigint, short bigint")


def _like(x: Column | str, y: Column | str) -> Column:
    """Whether the bits that rows of keys carry allow the similarity."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.bit_count(x.bitwiseXOR(y)) <= FAR_SHORT


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``x, y`` of nodes whose texts are near copies, as
    ``a, b``."""

    def make():
        sets: dict[int, np.ndarray] = {}
        held = 0

        def get(key: int, column: pa.Array, i: int) -> np.ndarray:
            nonlocal held
            s = sets.get(key)
            if s is None:
                if held > KEPT:
                    sets.clear()
                    held = 0
                s = sets[key] = shingle_set(column[i].as_py())
                held += len(s)
            return s

        def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            good = np.array([
                similar(get(i, batch.column(2), k), get(j, batch.column(3), k))
                for k, (i, j) in enumerate(zip(x.tolist(), y.tolist()))
            ], bool)
            return {"a": x[good], "b": y[good]}

        return run

    one = texts.select(F.col("row").alias("x"), F.col("text").alias("text_x"))
    two = texts.select(F.col("row").alias("y"), F.col("text").alias("text_y"))
    rows = salted_join(pairs.select("x", "y"), two, "y", key_counts(pairs, "y"), pairs.count()).join(one, "x")
    return map_batches(rows.select("x", "y", "text_x", "text_y"), make, "a bigint, b bigint")


def _apart(x: str, y: str, word: str, n: int) -> Column:
    """Bits that differ in words of two nodes."""
    return sum((F.bit_count(F.col(f"{x}{word}{k}").bitwiseXOR(F.col(f"{y}{word}{k}"))) for k in range(n)), F.lit(0))


def _allowed(x: str, y: str) -> Column:
    """Whether sizes, marks and fingerprints of two nodes (columns under
    prefixes) allow the similarity; only the fingerprint may err."""
    a, b = F.col(f"{x}size"), F.col(f"{y}size")
    return (
        (F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR)
        & (_apart(x, y, "m", MARKS) * (NUMERATOR + DENOMINATOR) <= (a + b) * (DENOMINATOR - NUMERATOR))
        & (_apart(x, y, "f", WORDS) <= FAR)
    )


def _info(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(F.col("node").alias(prefix), *(F.col(c).alias(f"{prefix}{c}") for c in INFO))


def _near(pairs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct pairs ``x > y`` that the sketches allow, with the bits of
    the fingerprints that differ."""
    pairs = scratch.table(pairs.distinct())
    both = salted_join(pairs, _info(nodes, "y"), "y", key_counts(pairs, "y"), pairs.count()).join(_info(nodes, "x"), "x")
    out = scratch.table(both.where(_allowed("x", "y")).select("x", "y", _apart("x", "y", "f", WORDS).alias("apart")))
    scratch.drop(pairs)
    return out


def _across(members: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """As ``_near``, of all members of a bucket in different groups.  The
    members bring their whole sketches, so that a pair that these reject
    is never a row."""
    told = scratch.table(members.select("key", "node", "label", "short").join(nodes.select("node", *INFO), "node"))
    x, y = (told.select(F.col("node").alias(p), *(F.col(c).alias(f"{p}{c}") for c in ("key", "label", "short", *INFO))) for p in ("x", "y"))
    of_two = (F.col("xkey") == F.col("ykey")) & (F.col("xlabel") < F.col("ylabel")) & _like("xshort", "yshort") & _allowed("x", "y")
    out = scratch.table(
        x.join(y, of_two).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"), _apart("x", "y", "f", WORDS).alias("apart"))
        .distinct()
    )
    scratch.drop(told)
    return out


def _labelled(rows: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """Rows with the label of a node that may be hot (its own without a
    link)."""
    one = labels.select(F.col("node").alias(node), F.col("label").alias(label))
    out = salted_join(rows, one, node, key_counts(rows, node), rows.count(), "left")
    return out.withColumn(label, F.coalesce(label, node))


def _linked(close: DataFrame, labels: DataFrame | None, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after verifying the pairs that would join two groups, the
    nearest of each node first."""
    so_far = lambda: [] if labels is None else [labels.select(F.col("node").alias("a"), F.col("label").alias("b"))]
    best = scratch.table(close.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("b")).select("x", F.col("b.y").alias("y")))
    found = scratch.table(_verified(best, texts))
    labels = scratch.table(components(reduce(DataFrame.unionByName, so_far(), found)))
    rest = close.join(best.withColumnRenamed("y", "done"), "x").where("y != done").select("x", "y")
    rest = _labelled(scratch.table(rest), labels, "x", "lx")
    rest = _labelled(scratch.table(rest), labels, "y", "ly").where("lx != ly").select("x", "y")
    rest = scratch.table(rest)
    if not rest.isEmpty():
        more = scratch.table(_verified(rest, texts))
        if not more.isEmpty():
            labels = scratch.table(components(reduce(DataFrame.unionByName, so_far(), more)))
    return labels


def _mixed(members: DataFrame, labels: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """``key, node, short, n, label`` of the buckets with members of several
    groups."""
    now = scratch.table(_labelled(members, labels, "node", "label"))
    mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    mixed = mixed.where("low < high").select("key", "n")
    return scratch.table(salted_join(now, mixed.select("key"), "key", mixed, total))


def node_labels(nodes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label`` of all linked nodes, from their sketches and texts
    by ``row``."""
    total = 2 * nodes.count() * KEYS
    keys = _key_rows(nodes)
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("short").alias("apart"))
    alike = (F.col("n") > 2) | (F.bit_count("apart") <= FAR_SHORT)  # of two members, the bits that differ
    buckets = scratch.table(buckets.where((F.col("n") > 1) & alike).select("key", "n"))
    left = scratch.table(salted_join(keys, buckets, "key", buckets, total))
    scratch.drop(buckets)
    labels: DataFrame | None = None
    for turn in range(STARS + 2):
        if labels is None:  # the keys of the first segments: most of a large group meets there
            now = left.where(F.col("key") < (1 << 12 * JOINED + CLASS)).withColumn("label", F.col("node"))
        else:
            now = left = _mixed(left.select("key", "node", "short", "n"), labels, total, scratch)
            if now.isEmpty():
                break
        if turn <= STARS:  # a centre for each bucket: the largest groups have small labels
            order = F.col("label") if turn < 2 else F.xxhash64("node", F.lit(turn))
            centre = now.groupBy("key").agg(
                F.min(F.struct(order.alias("o"), "node", "label", "short")).alias("c"), F.count("*").alias("n")
            )
            other = centre.select("key", F.col("c.node").alias("other"), F.col("c.label").alias("ol"), F.col("c.short").alias("os"))
            pairs = salted_join(now.drop("n"), other, "key", centre.select("key", "n"), total)
            pairs = pairs.where((F.col("label") != F.col("ol")) & _like("short", "os")).select("node", "other")
        if turn == 1:  # small buckets hold at most SMALL nodes each
            few = now.where((F.col("n") > 2) & (F.col("n") <= SMALL))
            few = few.groupBy("key").agg(F.collect_list(F.struct("node", "label", "short")).alias("m")).select(F.explode("m").alias("a"), "m")
            few = few.select("a", F.explode(F.filter("m", lambda y: (y["node"] < F.col("a.node")) & (y["label"] != F.col("a.label")) & _like(y["short"], "a.short"))).alias("b"))
            pairs = pairs.unionByName(few.select(F.col("a.node").alias("node"), F.col("b.node").alias("other")))
            left = now.where(F.col("n") > SMALL)
        if turn > STARS:
            close = _across(now, nodes, scratch)
        else:
            close = _near(pairs.select(F.greatest("node", "other").alias("x"), F.least("node", "other").alias("y")), nodes, scratch)
        if close.isEmpty():
            labels = labels if labels is not None else nodes.select("node", F.col("node").alias("label")).limit(0)
            continue
        touched = Bitmap(close.select(F.explode(F.array("x", "y")).alias("row")).select(F.xxhash64("row").alias("h")), "h")
        held = scratch.table(texts.withColumn("hit", touched.column(F.xxhash64("row"))).where("hit").select("row", "text"))
        labels = _linked(close, labels, held, scratch)
        scratch.drop(close, held)
        collect_garbage(nodes.sparkSession)
    return labels


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, all columns as they are: the
    row with the smallest id (null ids last); of rows that share it, any
    one.  Null and empty texts are one group."""
    keep, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    base = keep.table(
        docs.select(
            F.struct("*").alias("doc"), F.col(id_col).alias("id"), _sketch(text_col).alias("sketch"),
            F.monotonically_increasing_id().alias("row"),
        ).select("doc", "id", "row", "sketch.*")
    )
    # copies of a set are combined before the shuffle
    nodes = scratch.table(
        base.groupBy("k1", "k2").agg(
            F.min(F.struct("row", *INFO, "codes")).alias("node"),
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"),
        ).select(F.col("node.row").alias("node"), *(f"node.{c}" for c in INFO), "node.codes", "best")
    )
    collect_garbage(docs.sparkSession)
    labels = node_labels(nodes, base.select("row", F.col("doc")[text_col].alias("text")), scratch)
    best = keep.table(
        nodes.select("node", "best").join(labels, "node", "left")
        .groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("best").alias("best"))
        .select(F.col("best.row").alias("row"))
    )
    # those that go are fewer than those that stay: texts move only if Spark finds them too many to broadcast
    gone = keep.table(base.select("row").join(best, "row", "left_anti"))
    scratch.drop()
    return base.join(gone, "row", "left_anti").select("doc.*")
