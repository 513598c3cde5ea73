"""Helpers that the operators share: scratch tables in the shared folder, word hashes, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session uses a folder
    of its own in the warehouse; a cluster must name one."""
    key = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} must name a folder that driver and executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.spindle"
        spark.conf.set(key, found)
    return found.rstrip("/")


def release() -> None:
    """Give memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def release_driver(spark: SparkSession) -> None:
    """Give memory that the driver's JVM has freed back to the system: its hundreds of threads take native memory from the
    C library's arenas, which keep what is freed. A JVM that can't do this is left as it is."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # by the interface: the server's own class is closed to reflection
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):
        invoke.invoke(server, args)


def tidy(f: Callable) -> Callable:
    """A mapInArrow function that gives its memory back to the system when it ends: workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


#: For a scratch folder on a local disk: for each file that it makes, and again for the checksums beside it, Hadoop's file
#: system starts a `chmod` (four for a table's file, one without checksums), whose process shares the JVM's memory until it
#: has begun and is counted with it. Other stores ignore the first two.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Least files of a table whose rows are counted, if it is dealt to as many tasks; and rows of a file beyond these.
FILES, FILE_ROWS = 12, 50_000


class Scratch:
    """Tables written to the shared folder. They cut lineage, survive lost executors, and may be dropped when no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/spindle-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write df as Parquet and read it again; the shuffle files behind it can then go. rows: about how many df has,
        where tasks may be joined, so that few rows go to few files."""
        self.count += 1
        if rows is not None:
            df = df.coalesce(max(FILES, -(-rows // FILE_ROWS)))
        path, schema = f"{self.root}/{self.count}", df.schema
        df.write.options(compression="zstd", **PLAIN).parquet(path)
        release_driver(self.spark)
        out = self.spark.read.schema(schema).parquet(path)
        out._spindle_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of keep() that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._spindle_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Collect dead plans on the driver: Spark deletes a shuffle's files once its plan is garbage. The first round
        lets go of the Python side's handles; rounds go on while shuffles still disappear."""
        known = self.spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
        held, idle = known.size(), 0
        for _ in range(12):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.25)
            now = known.size()
            idle = idle + 1 if now >= held else 0
            held = now
            if not held or idle >= 3:
                break
        release_driver(self.spark)


class WordHash(dict):
    """Word -> 64-bit hash, remembered for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def texts(col: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, one value at a time."""
    for v in col.cast(pa.large_binary()) if not pa.types.is_binary(col.type) else col:
        yield v.as_py()


def per_batch(f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None]):
    """mapInArrow function from a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return run


class Forest:
    """Union-find over integers in which the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges -> a spanning forest of each block of at most about 200,000 of them, as (node, smallest node)."""
    forest = Forest()

    def out() -> pa.RecordBatch:
        nodes = [x for x in forest.up if forest.root(x) != x]
        return batch(EDGE, [nodes, [forest.root(x) for x in nodes]])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(x, y)
        if len(forest.up) > 200_000:
            yield out()
            forest = Forest()
    if forest.up:
        yield out()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of edges(a, b): comp is the smallest node reachable.

    Each round maps every node to its smallest neighbour, follows those pointers to their end, and contracts the graph
    by that map. A map applied to both ends of all edges keeps connectivity, and each round at least halves the nodes
    of every component. All steps are joins and partial aggregations; none gathers a component in one task.
    """
    e = scratch.keep(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(tidy(contract), "a long, b long"))
    labels, most = None, 2 * e.count()  # nodes, and no table below has more rows
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        p = scratch.keep(both.groupBy("u").agg(F.min("v").alias("r")).select("u", F.least("u", "r").alias("r")), most)
        while True:
            q = p.select(F.col("u").alias("r"), F.col("r").alias("r2"))
            jumped = scratch.keep(p.join(q, "r").select("u", F.col("r2").alias("r"), (F.col("r2") != F.col("r")).alias("moved")), most)
            scratch.drop(p)
            p, moved = jumped.drop("moved"), jumped.where("moved").limit(1).count()
            p._spindle_path = jumped._spindle_path
            if not moved:
                break
        if labels is None:
            labels = scratch.keep(p.select(F.col("u").alias("node"), F.col("r").alias("comp")), most)
        else:
            old = labels
            labels = scratch.keep(old.join(p, old.comp == p.u, "left").select("node", F.coalesce("r", "comp").alias("comp")), most)
            scratch.drop(old)
        pa_, pb = p.select(F.col("u").alias("a"), F.col("r").alias("ra")), p.select(F.col("u").alias("b"), F.col("r").alias("rb"))
        rest = scratch.keep(e.join(pa_, "a").join(pb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), most)
        scratch.drop(e, p)
        e = rest
        if not e.limit(1).count():
            scratch.drop(e)
            return labels


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
