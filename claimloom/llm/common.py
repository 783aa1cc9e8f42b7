"""Shared pieces: Arrow batching, intermediate tables, joins on hot keys,
bitmaps, labels of connected components, spans."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Arrow data handed to a Python worker at once.  Long texts
#: make small batches, so that a worker's memory is bounded.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Give freed memory back: workers outlive their tasks, and what the
    allocators keep of large batches would add up from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """The function of an Arrow UDF, with ``trim`` after each batch."""

    def run_and_trim(values: pa.Array) -> pa.Array:
        out = run(values)
        trim()
        return out

    return run_and_trim


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], schema: str
) -> DataFrame:
    """``mapInArrow`` with a per-task function from a batch to columns.

    ``make`` runs once a task (caches and models live in its closure);
    its function returns the columns of ``schema`` by name.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                cols = f(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[x.name], x.type) for x in arrow], schema=arrow
                )
        del f
        trim()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all machines see.

    ``spark.checkpoint.dir`` decides; only on a local master may it be
    unset (tests, a single machine): then a folder of this process takes
    its place.
    """
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
        at = sc._jsc.sc().getCheckpointDir()
    return at.get()


class Scratch:
    """Tables of one computation in the shared folder.

    A table cuts lineage at a fraction of a checkpoint's size.  Tables
    that nothing reads any more are dropped by ``drop``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/tables-{uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        """The rows, written and to be read again."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete some tables; without any, all of them."""
        paths = [t._scratch for t in tables] if tables else [self.folder]
        jvm = self.spark.sparkContext._jvm
        for x in paths:
            at = jvm.org.apache.hadoop.fs.Path(x)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so when
    the driver's garbage is collected, which may else take the whole run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a compressed table in the shared folder, a fraction
    of a checkpoint's size for many rows."""
    return Scratch(df.sparkSession).table(df)


#: A key is hot above this many rows and above one in ``HOT_KEYS`` of all
#: rows, so there are fewer hot keys than ``HOT_KEYS``.
HOT_ROWS, HOT_KEYS = 2_048, 1 << 16


def hot_limit(total: int) -> int:
    """Rows of a key that one task takes, of ``total`` rows."""
    return max(HOT_ROWS, total // HOT_KEYS)


def salted_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """``many.join(one, key)`` where one key may hold a third of ``many``.

    ``one`` has each key once, ``counts`` the number of rows (``n``) of a
    key in ``many``.  Rows of a hot key are dealt by their hash, and the
    key's row of ``one`` is repeated for each share.  Fewer than
    ``HOT_KEYS`` keys can be hot, which bounds the broadcast (16 bytes
    each) and the repeats.
    """
    least = hot_limit(total)
    hot = F.broadcast(
        counts.where(F.col("n") > least).select(F.col(key), F.ceil(F.col("n") / least).cast("int").alias("_tiles"))
    )
    tiles = F.coalesce("_tiles", F.lit(1))
    a = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), tiles).cast("int")).drop("_tiles")
    b = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), tiles - 1))).drop("_tiles")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows of each key: ``key, n`` (combined before the shuffle)."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


#: log2 of the bits of a bitmap (8 MB).
BITMAP = 26


class Bitmap:
    """Broadcast bitmap of fixed size over hashes: tells which rows to
    send on.  False hits cost rows but never change results."""

    def __init__(self, rows: DataFrame, col: str):
        words = (
            rows.groupBy(F.expr(f"shiftright({col}, 6) & {(1 << (BITMAP - 6)) - 1}").alias("word"))
            .agg(F.expr(f"bit_or(shiftleft(1L, cast({col} & 63 AS int)))").alias("bits"))
            .toArrow()
        )
        out = np.zeros(1 << (BITMAP - 6), np.int64)
        out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        self.shared = rows.sparkSession.sparkContext.broadcast(out.view(np.uint64))

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes may be among the rows'."""
        word = self.shared.value[(h >> np.uint64(6) & np.uint64((1 << (BITMAP - 6)) - 1)).astype(np.int64)]
        return (word >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)

    def column(self, col) -> Column:
        """``has`` of a column of hashes (longs)."""

        def run(a: pa.Array) -> pa.Array:
            return pa.array(self.has(a.to_numpy().view(np.uint64)), pa.bool_())

        return F.arrow_udf(run, "boolean")(col)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label the connected components of an undirected graph.

    Alternating large-star and small-star steps (Kiveris et al.): every
    step is a distinct and one aggregation over the edges, no hub is
    gathered into one row or one task, and the edge set never grows.
    Ends when a round leaves the edges as they were.  Returns
    ``node, label``, the label being the smallest node of the component;
    loops and repeated edges are fine, nodes without an edge do not
    appear.
    """
    scratch = Scratch(edges.sparkSession)
    mark_of = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    cur = scratch.table(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    mark = mark_of(cur)
    seen = None
    while mark != seen:
        total = 2 * mark[0]
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # large-star: each larger neighbour of u goes to u's smallest
        large = (
            salted_join(both.where("v > u"), low.select("u", "m"), "u", low, total)
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        # small-star: u and its smaller neighbours go to the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        nxt = scratch.table(
            salted_join(large, low2.select("u", "m"), "u", low2, total)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u != v").distinct()
        )
        scratch.drop(cur)
        seen, mark, cur = mark, mark_of(nxt), nxt
    pairs = cur.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return pairs.union(roots)


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end`` in the order given, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def free(taken: list[tuple[int, int]], spans) -> list[tuple]:
    """Those of the spans (``start, end, ...``, by start, none empty) that
    overlap none of the taken ones (by start); linear in both."""
    out, k, reach = [], 0, 0
    for span in spans:
        s, e = span[:2]
        while k < len(taken) and taken[k][0] < e:  # all that start before its end
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= s:
            out.append(span)
    return out
