"""Packing tokenised documents into sequences, as a cutting-stock problem solved by column generation.

Documents longer than a sequence give whole sequences and one remainder. The histogram of remainders, in classes of
GRAIN tokens, is all that the driver sees: a linear program over patterns (how many pieces of each class share a
sequence) is solved by column generation, where a knapsack dynamic program prices new patterns against the dual values.
Rounded down, the patterns are laid over the pieces of each class in the order of their rank. What rounding leaves
(fewer pieces than the patterns hold, however many documents there are) is laid end to end and cut at sequence ends;
its tail is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, tidy
from .tokens import ids_of

END = (2).to_bytes(4, "little")
GRAIN = 16
#: Rows ranked together; ranks of larger classes are put together from parts.
PART = 50_000

PIECE = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("doc_tokens", pa.int64()), ("salt", pa.int64())])
PIECE_SQL = "id long, start long, length long, crc long, doc_tokens long, salt long"


def cutter(path: str, size: int):
    """(id, text) -> whole sequences and the remainder of each document. salt tells rows that repeat an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for i, x in zip(b.column(0).to_pylist(), ids.encode_all(b.column(1)), strict=True):
                x += END
                salt = zlib.crc32(x)
                for at in range(0, len(x), 4 * size):
                    part = x[at : at + 4 * size]
                    for col, v in zip(cols, (i, at // 4, len(part) // 4, zlib.crc32(part), len(x) // 4, salt), strict=True):
                        col.append(v)
            yield batch(PIECE, cols)

    return run


def patterns(demand: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """Column generation for pieces of 1..room units, demand[k - 1] of k: [(pieces of each size, sequences)], rounded down.

    The master is a covering program, minimise sequences so that each size is covered; its basis is kept as an inverse.
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return []
    want = demand[sizes - 1].astype(float)
    want_d = want + 1e-3 * (1 + np.arange(m)) / m  # breaks ties, so that the simplex moves on
    # start: patterns of one size
    columns = np.diag(room // sizes).astype(float)
    inverse, x = np.diag(1 / np.diag(columns)), want_d / np.diag(columns)
    for _ in range(60 * m + 500):
        dual = inverse.sum(axis=0)
        # knapsack: best[c] is the most dual value within c units
        best, pick = np.zeros(room + 1), np.full(room + 1, -1)
        for c in range(1, room + 1):
            k = int(np.searchsorted(sizes, c, "right"))
            best[c], pick[c] = best[c - 1], -1
            if k:
                v = dual[:k] + best[c - sizes[:k]]
                j = int(v.argmax())
                if v[j] > best[c] + 1e-12:
                    best[c], pick[c] = v[j], j
        if best[room] <= 1 + 1e-7:
            break
        new, c = np.zeros(m), room
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                new[pick[c]] += 1
                c -= int(sizes[pick[c]])
        step = inverse @ new
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / step[up]
        out = int(ratio.argmin())
        theta = ratio[out]
        x -= theta * step
        x[out] = theta
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = new
    left, plan = want.copy(), []
    for j in np.argsort(-x):
        use = columns[:, j]
        n = int(min(np.floor(x[j] + 1e-6), *(left[use > 0] // use[use > 0])))
        if n > 0:
            left -= n * use
            plan.append(({int(sizes[k]): int(use[k]) for k in np.flatnonzero(use)}, n))
    # what rounding left: fill sequences greedily, largest first, as long as they come out nearly full
    while left.sum():
        use, c = {}, room
        for k in range(m - 1, -1, -1):
            n = int(min(left[k], c // sizes[k]))
            if n:
                use[int(sizes[k])] = n
                c -= n * int(sizes[k])
        if c > max(1, room // 64):
            break
        n = int(min(left[np.searchsorted(sizes, s)] // u for s, u in use.items()))
        for s, u in use.items():
            left[np.searchsorted(sizes, s)] -= n * u
        plan.append((use, n))
    return plan


def recount(path: str):
    """(id, text, salt, cuts as (start, length, sequence, offset)) -> the pieces with their digests."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("doc_tokens", pa.int64()), ("seq", pa.int64()), ("off", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for i, t, salt, cuts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = ids.encode(t or "") + END
                if zlib.crc32(x) != salt:
                    continue
                for c in cuts:
                    part = x[4 * c["start"] : 4 * (c["start"] + c["length"])]
                    for col, v in zip(cols, (i, c["start"], c["length"], zlib.crc32(part), len(x) // 4, c["seq"], c["off"]), strict=True):
                        col.append(v)
            yield batch(schema, cols)

    return run


def pack(docs: DataFrame, path: str, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every document in exactly one piece.

    A null text is the end id alone; rows with a null id are packed under it; rows that repeat an id with its text each
    get pieces; an empty table gives none. No sequence is longer than size, which is a multiple of GRAIN.
    """
    spark = docs.sparkSession
    scratch, room = Scratch(spark), size // GRAIN
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.keep(src.mapInArrow(tidy(cutter(path, size)), PIECE_SQL).withColumn("klass", F.ceil(F.col("length") / GRAIN).cast("int")))
    # The histogram has at most `room` rows.
    rows = pieces.groupBy("klass").agg(F.count("*").alias("n")).collect()
    demand = np.zeros(room, dtype=np.int64)
    for r in rows:
        demand[r["klass"] - 1] = r["n"]
    plan = patterns(demand, room)
    lays, base, used = [], 0, np.zeros(room + 1, dtype=np.int64)
    for use, n in plan:
        for k, u in use.items():
            lays.append((k, int(used[k]), int(used[k] + u * n), u, base))
            used[k] += u * n
        base += n
    total = int(demand.sum())

    # Rank within a class: the order within one of its parts, after the rows of the parts before.
    parts = max(1, total // PART)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("id", "start", "salt"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("klass", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("klass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("klass", "part", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("klass", "part").orderBy("id", "start", "salt")
    ranked = scratch.keep(dealt.withColumn("own", F.row_number().over(order) - 1).join(before, ["klass", "part"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "part"))

    # The lays have at most room * (patterns) rows whatever the documents; they are bounded by the plan's size.
    laid = spark.createDataFrame(lays or [(0, 0, 0, 1, 0)], "k int, lo long, hi long, each long, base long")
    on = (F.col("klass") == F.col("k")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    set_ = ranked.join(F.broadcast(laid), on).withColumn("seq", F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")))
    inner = Window.partitionBy("seq").orderBy(F.desc("klass"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    fitted = set_.withColumn("off", F.coalesce(F.sum("length").over(inner), F.lit(0))).select("id", "start", "length", "crc", "doc_tokens", "seq", "off")

    # The rest: its size depends on the classes, not on the documents, so one window orders it.
    top = spark.createDataFrame([(k, int(used[k])) for k in range(1, room + 1)], "klass int, used long")
    rest = ranked.join(F.broadcast(top), "klass").where("rank >= used")
    line = rest.withColumn("at", F.coalesce(F.sum("length").over(Window.orderBy("klass", "rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    line = scratch.keep(line.select("id", "start", "length", "doc_tokens", "salt", "at"))
    end = line.agg(F.max(F.col("at") + F.col("length"))).first()[0] or 0
    bounds, at = list(range(0, end // size * size, size)), end // size * size
    while at < end:
        bounds.append(at)
        at += 1 << ((end - at).bit_length() - 1)
    marks = spark.createDataFrame([(int(lo), int(hi), base + n) for n, (lo, hi) in enumerate(zip(bounds, [*bounds, end][1:], strict=True))] or [(0, 0, 0)], "lo long, hi long, seq long")
    over = (F.col("lo") < F.col("at") + F.col("length")) & (F.col("hi") > F.col("at"))
    bits = line.join(F.broadcast(marks), over)
    lo, hi = F.greatest("lo", "at"), F.least("hi", F.col("at") + F.col("length"))
    bits = bits.select("id", "salt", (F.col("start") + lo - F.col("at")).alias("start"), (hi - lo).alias("length"), "seq", (lo - F.col("lo")).alias("off"))
    cuts = bits.groupBy("id", "salt").agg(F.collect_list(F.struct("start", "length", "seq", "off")).alias("cuts"))
    # Rows that repeat an id with its text have one entry each in the cuts, and are to be read once.
    cuts = scratch.keep(cuts)
    again = src.join(F.broadcast(cuts.select(F.col("id").alias("i"))).distinct(), F.col("id").eqNullSafe(F.col("i")), "left_semi").dropDuplicates(["id", "text"])
    ends = again.join(F.broadcast(cuts.select(F.col("id").alias("i"), "salt", "cuts")), F.col("id").eqNullSafe(F.col("i"))).select("id", "text", "salt", "cuts")
    cut = ends.mapInArrow(tidy(recount(path)), "id long, start long, length long, crc long, doc_tokens long, seq long, off long")
    out = fitted.unionByName(cut)
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("seq").alias("sequence_id"), F.col("off").alias("offset"))
