"""Best documents by shared terms, from blocks of requests and documents.

Requests and documents are packed into blocks of bounded size; every block
of requests meets every block of documents once, without a row for a
pair.  Within a pair of blocks, scores are accumulated term at a time:
frequent terms are dense rows over the documents, the others postings.
A task keeps the best documents of each request from block to block.
Postings come first; dense rows are read only for documents that can still
reach the k-th best so far, by the most that the rows can add.  Documents
left out score less than k others, so counts and ranks are exact.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Requests of a block; documents of a block, and bytes of their terms
#: (a vocabulary and numbers take a fourth of that); bytes of a batch.
REQUESTS, DOCUMENTS, BYTES, BATCH_BYTES = 16_384, 8_192, 36 << 20, 8 << 20
#: A term is dense in one of so many documents of a block or more.
DENSE = 32
#: Requests whose scores are held at once, and postings added at once.
CHUNK, POSTINGS = 128, 1 << 18
#: Parts of the documents at least: tasks are the pairs of parts and blocks.
PARTS = 4
#: No terms.
NONE = pa.array([], pa.string())


def _array(column: pa.ChunkedArray) -> pa.Array:
    array = column.combine_chunks()
    return pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths and members of lists (null: empty)."""
    array = _array(column)
    return np.asarray(pc.fill_null(pc.list_value_length(array), 0)).astype(np.int64), array.flatten()


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers from each start on, as many as its length, after one another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _packed(table: pa.Table, unasked: pa.Array) -> bytes:
    """Ids, lengths and codes of lists of terms, their counts (none if all
    are one) and the vocabulary, as lists in one row, without the terms in
    ``unasked``."""
    sizes, terms = _lists(table.column(1))
    counts = np.asarray(_lists(table.column(2))[1]).astype(np.int64)
    coded = terms.dictionary_encode()
    codes, vocabulary = coded.indices, coded.dictionary
    if len(unasked):
        stays = ~np.asarray(pc.is_in(vocabulary, value_set=unasked))
        codes = np.asarray(codes)
        here = stays[codes]
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[here], minlength=len(sizes))
        codes, counts = pa.array((np.cumsum(stays) - 1)[codes[here]].astype(np.int32)), counts[here]
        vocabulary = vocabulary.filter(pa.array(stays))
    whole = [_array(table.column(0)), pa.array(sizes.astype(np.int32)), codes, pa.array(counts if (counts != 1).any() else counts[:0]),
             vocabulary]
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in whole], list("abcde"))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema) as writer:
        writer.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    ids, sizes, codes, counts, vocabulary = (_array(c).flatten() for c in pa.ipc.open_stream(data).read_all().columns)
    codes = np.asarray(codes).astype(np.int64)
    return ids, np.asarray(sizes).astype(np.int64), codes, np.asarray(counts) if len(counts) else np.ones(len(codes), np.int64), vocabulary


def _pack(rows: DataFrame, most: int, unasked: pa.Array = NONE) -> DataFrame:
    """Rows in blocks of at most ``most``, without the terms in ``unasked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0

        def block() -> pa.RecordBatch:
            data = _packed(pa.Table.from_batches(held), unasked)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["block"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, min(most - n, 512))
                held.append(part)
                at, n, size = at + part.num_rows, n + part.num_rows, size + part.get_total_buffer_size() * part.num_rows // b.num_rows
                if n >= most or size >= BYTES:
                    yield block()
                    n = size = 0
        if held:
            yield block()

    return rows.mapInArrow(run, "block binary")


class Asked:
    """A block of requests and the best documents of each so far."""

    def __init__(self, data: bytes, k: int):
        self.k = k
        self.ids, n, self.codes, self.counts, self.vocabulary = _unpacked(data)
        self.ends = np.cumsum(n)
        self.owner = np.repeat(np.arange(len(n)), n)
        self.most = int(np.bincount(self.owner, self.counts, len(n)).max()) if len(n) else 0
        self.least = np.zeros(len(n), np.int64)  # scores of the k-th best, 0 while there are fewer
        self.last: np.ndarray | None = None  # their ids
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(n)
        self.without: list[tuple[int, int]] = []  # requests, scores of the documents without an id

    def meet(self, data: bytes) -> None:
        ids, sizes, code, weight, vocabulary = _unpacked(data)
        valid = np.asarray(ids.is_valid())
        keys = ids.drop_null().to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(valid)[np.argsort(keys, kind="stable")], np.flatnonzero(~valid)])
        keys, n = np.sort(keys, kind="stable"), len(order)
        if self.last is None:
            self.last = np.zeros(len(self.ends), keys.dtype)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        code = np.asarray(pc.fill_null(pc.index_in(vocabulary, value_set=self.vocabulary), -1)).astype(np.int64)[code]
        known = np.flatnonzero(code >= 0)
        if not len(known):
            return
        code, doc, weight = code[known], np.repeat(place, sizes)[known], weight[known]
        by = np.argsort(code, kind="stable")
        code, doc, weight = code[by], doc[by], weight[by]
        df = np.bincount(code, minlength=len(self.vocabulary))
        ends = np.cumsum(df)
        bound = self.most * int(weight.max())
        kind = np.uint8 if bound < 2**8 else np.uint16 if bound < 2**16 else np.int64
        weight = weight.astype(kind)
        frequent = np.flatnonzero(df >= max(1, n // DENSE))
        row = np.full(len(df), -1)
        row[frequent] = np.arange(len(frequent))
        dense = np.zeros((len(frequent), n), kind)
        here = row[code] >= 0
        dense[row[code[here]], doc[here]] = weight[here]
        hits, rows = df[self.codes] > 0, row[self.codes]
        common, others = np.flatnonzero(hits & (rows >= 0)), np.flatnonzero(hits & (rows < 0))
        size = len(self.ends)
        # of each request: its entries among both, postings of the others, the most that both can add to a score
        of_common = np.searchsorted(self.owner[common], np.arange(size + 1))
        of_others = np.searchsorted(self.owner[others], np.arange(size + 1))
        postings = np.append(0, np.cumsum(df[self.codes[others]]))[of_others]
        peak = dense.max(1).astype(np.int64) if len(frequent) else np.zeros(0, np.int64)
        by_common = np.append(0, np.cumsum(self.counts[common] * peak[rows[common]]))[of_common]
        by_common = by_common[1:] - by_common[:-1]
        by_others = np.append(0, np.cumsum(self.counts[others]))[of_others]
        by_others = (by_others[1:] - by_others[:-1]) * int(weight.max())
        plain = bool((self.counts == 1).all() and weight.max() == 1)
        first = 0
        while first < size:
            last = min(first + CHUNK, max(first + 1, int(np.searchsorted(postings, postings[first] + POSTINGS, "right")) - 1))
            part = np.zeros((last - first, n), kind)
            entries = others[of_others[first] : of_others[last]]
            if postings[last] - postings[first] > POSTINGS:  # of one request
                for t, q in zip(self.codes[entries].tolist(), self.counts[entries].tolist()):
                    at = slice(ends[t] - df[t], ends[t])
                    part[0, doc[at]] += weight[at] * kind(q)
            elif len(entries):
                t = self.codes[entries]
                at = _ranges(ends[t] - df[t], df[t])
                add = np.ones(len(at), kind) if plain else weight[at] * np.repeat(self.counts[entries], df[t]).astype(kind)
                np.add.at(part.reshape(-1), doc[at] + np.repeat((self.owner[entries] - first) * n, df[t]), add)
            # a document can only be among the best if the others add what the common terms cannot
            least = self.least[first:last]
            need = least - by_common[first:last]
            live = np.ones(last - first, bool) if n > len(keys) else by_common[first:last] + by_others[first:last] >= np.maximum(least, 1)
            few = live & (need > 0)
            which = np.flatnonzero(few)
            able = part[which] >= np.minimum(need[which], np.iinfo(kind).max).astype(kind)[:, None]
            able[need[which] > np.iinfo(kind).max] = False
            able[:, len(keys) :] = True
            n_common = np.diff(of_common)[first:last]
            fits = np.count_nonzero(able, 1) * np.maximum(n_common[which], 1) <= n
            few[which[~fits]] = False
            at, d = np.divmod(np.flatnonzero(able if fits.all() else able[fits]), n)
            r = which[fits][at]
            reps = n_common[r]
            term = common[_ranges(of_common[first:last][r], reps)]
            adds = np.append(0, np.cumsum(dense[rows[term], np.repeat(d, reps)].astype(np.int64) * self.counts[term]))
            stop = np.cumsum(reps)
            full = part[r, d].astype(np.int64) + adds[stop] - adds[stop - reps]
            enough = full > least[r]
            if len(keys):  # a tie needs a smaller id
                tie = np.flatnonzero((full == least[r]) & (full > 0) & (d < len(keys)))
                enough[tie] = ~(keys[d[tie]] > self.last[first + r[tie]])
            stays = np.flatnonzero(enough | ((d >= len(keys)) & (full > 0)))
            r, d, full = r[stays], d[stays], full[stays]
            cuts = np.flatnonzero(np.diff(r, prepend=-1, append=-1))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                m = i + int(np.searchsorted(d[i:j], len(keys)))
                self.without += [(first + int(r[i]), x) for x in full[m:j].tolist()]
                self._keep(first + int(r[i]), full[i:m], keys[d[i:m]])
            for x in np.flatnonzero(live & ~few).tolist():
                scores, c = part[x], common[of_common[first + x] : of_common[first + x + 1]]
                if len(c):
                    taken = dense.take(rows[c], 0)
                    scores += np.add.reduce(taken if plain else taken * self.counts[c].astype(kind)[:, None], 0, dtype=kind)
                self.without += [(first + x, y) for y in scores[len(keys) :].tolist() if y]
                self._keep(first + x, scores[: len(keys)], keys)
            first = last

    def _keep(self, r: int, scores: np.ndarray, keys: np.ndarray) -> None:
        """Merge a block's scores, documents by id, into the best so far."""
        best = self.best[r]
        if not len(scores):
            return
        top, least = int(scores.max()), 1
        if best is not None and len(best[0]) >= self.k:
            least = int(best[0][-1])
            if top < least or (top == least and keys[0] > best[1][-1]):
                return
        if not top:
            return
        at = np.flatnonzero(scores >= least)
        s = scores[at].astype(np.int64)
        if len(at) > self.k:
            cut = np.partition(s, len(s) - self.k)[len(s) - self.k]
            above = np.flatnonzero(s > cut)
            first = np.concatenate([above, np.flatnonzero(s == cut)[: self.k - len(above)]])
            at, s = at[first], s[first]
        ids = keys[at]
        if best is not None:
            s, ids = np.concatenate([best[0], s]), np.concatenate([best[1], ids])
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(-s[order], kind="stable")][: self.k]
        self.best[r] = s[order], ids[order]
        if len(order) == self.k:
            self.least[r], self.last[r] = self.best[r][0][-1], self.best[r][1][-1]

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        held = [(r, *b) for r, b in enumerate(self.best) if b is not None]
        at = [np.full(len(s), r) for r, s, _ in held] + [np.array([r for r, _ in self.without], np.int64)]
        scores = [s for _, s, _ in held] + [np.array([x for _, x in self.without], np.int64)]
        ids = [x for _, _, part in held for x in part.tolist()] + [None] * len(self.without)
        columns = [self.ids.take(pa.array(np.concatenate(at).astype(np.int64))), pa.array(ids, schema.field(1).type),
                   pa.array(np.concatenate(scores).astype(np.int64))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs.  Python gives up
    its objects a little later, so one call may serve only the next."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def best_documents(asked: DataFrame, docs: DataFrame, k: int, unasked: pa.Array = NONE) -> DataFrame:
    """``request_id, id, n_shared``: rows that hold the k best documents of
    each request (ties to the smaller id, no id last) and some others.

    ``asked`` has ``request_id, term``, ``docs`` has ``id, terms`` (distinct
    terms of a row); rows of one request or id add up.  No request may ask
    for a term in ``unasked``; the documents' blocks are packed without them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    listed = lambda df, key: (
        df.groupBy(key, "term").agg(F.count("*").alias("n")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("t"))
        .select(key, F.col("t.term").alias("terms"), F.col("t.n").alias("counts"))
    )
    requests = listed(asked, "request_id")
    collect_garbage(spark)
    blocks = max(1, -(-requests.count() // REQUESTS))
    repeated = docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    ones = F.transform("terms", lambda _: F.lit(1).cast("bigint"))
    if repeated.isEmpty():
        rows = docs.select("id", "terms", ones.alias("counts"))
    else:
        same = docs["id"].eqNullSafe(repeated["id"])
        single = docs.join(repeated, same, "left_anti").select("id", "terms", ones.alias("counts"))
        rows = single.unionByName(listed(docs.join(repeated, same, "left_semi").select("id", F.explode("terms").alias("term")), "id"))
        rows = rows.sortWithinPartitions("id", "terms")  # the same blocks in a retry
    collect_garbage(spark)
    parts = max(PARTS, -(-4 * spark.sparkContext.defaultParallelism // blocks))
    left = _pack(rows, DOCUMENTS, unasked).repartition(parts).select(F.col("block").alias("docs"))
    right = _pack(requests.repartition(blocks), REQUESTS)
    out = StructType([StructField("request_id", asked.schema["request_id"].dataType), StructField("id", docs.schema["id"].dataType),
                      StructField("n_shared", LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Asked] = {}
        for b in batches:
            for data, block in zip(b.column(0), b.column(1)):
                key = block.as_py()
                if key not in held:
                    held[key] = Asked(key, k)
                held[key].meet(data.as_py())
        for x in held.values():
            yield x.rows(arrow)

    # pairs of partitions meet in tasks of their own, nothing is collected or broadcast
    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(run, out)
