"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each signature of TREES * DEPTH values is read as TREES sorted orders. In an order, documents whose keys share a long
prefix stand side by side, so a document's candidates are its longest-common-prefix neighbours: in a dense region the
neighbours share more values than the least depth, in a thin one fewer, and that is how depth adapts to the region.
Candidates are confirmed on the full shingle sets, and confirmed links are joined to components.

Documents with equal sets are one class from the start, so exact copies cost one row each whatever their number. A first
pass links neighbours in a few orders; a second looks, in all orders, only at neighbours that are not yet connected.
The rows made by these are bounded by orders x WIDTH per document, however large a group is.

A prefix of the least depth that more rows share than stand side by side, and that still holds several components, is
open. All pairs of documents of open prefixes are settled exactly, by prefix filtering: shingles are sorted by rarity,
and two sets that reach the limit share one of their first shingles. No pair of different components that shares a
prefix is left unexamined unless this shows that it can't reach the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, WordHash, batch, components, mix, per_batch, texts, tidy, union

TREES, DEPTH, LEAST, WIDTH = 16, 8, 4, 3
#: Least depth for limits under 85: at a Jaccard of 0.80, 16 orders of 4 values miss one link in 4,600, of 3 values one in 97,000.
LOOSE, LEAST_LOOSE = 85, 3
#: Orders of the first pass.
FIRST = 3
#: Of the exact pass: counters of shingles, most shingles carried with a row, rows compared with as many others at once.
COUNTERS, CARRIED, BLOCK = 1 << 18, 256, 2000
#: Parts in which the driver fetches the counters.
FETCHED = 4
KEY = 1 + 4 * DEPTH

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 2**32, size=(TREES * DEPTH, 1), dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, size=(TREES * DEPTH, 1), dtype=np.uint32)
_C = _rng.integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes | None, words: int, seen: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, A-Z lower-cased; a shorter text is one shingle, an empty one none."""
    w = seen.array((text or b"").lower().split())
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h += mix(w[j : len(w) - k + 1 + j] + _C[j]) * _C[j]
    return np.unique(mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    h, out = (s >> np.uint64(16)).astype(np.uint32), None
    for i in range(0, len(h), 4096):
        m = (_A * h[i : i + 4096] + _B).min(axis=1)
        out = m if out is None else np.minimum(out, m)
    return out


SIGNED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("c", pa.binary()), ("sig", pa.binary())])


def signer(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for b in batches:
            n, c, sig = [], [], []
            for t in texts(b.column(1)):
                s = shingles(t, words, seen)
                n.append(len(s))
                c.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield batch(SIGNED, [b.column(0).cast(pa.int64()), n, c, sig])

    return run


ROW = pa.schema([("k", pa.binary()), ("id", pa.int64()), ("comp", pa.int64())])


def keys(trees: range):
    """Signatures -> a row for each order: its number and the DEPTH values that it sorts by."""

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for t in trees:
            at = slice(4 * DEPTH * t, 4 * DEPTH * (t + 1))
            yield batch(ROW, [[bytes([t]) + s[at] for s in b.column(1).to_pylist()], b.column(0), b.column(2)])

    return per_batch(one)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edge", pa.int32()), ("k", pa.binary()), ("comp", pa.int64())])
PAIR_SQL = "a long, b long, edge int, k binary, comp long"


def neighbours(width: int, least: int):
    """Sorted rows -> pairs of different components at most width rows apart that share least values, and the partition's ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, head, tail = TaskContext.get().partitionId(), [], None
        for b in batches:
            n = b.num_rows
            k = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(n, KEY)
            rows = (k, np.asarray(b.column(1)), np.asarray(b.column(2)))
            if len(head) < width:
                head += list(zip(*(x[: width - len(head)] for x in rows), strict=True))
            if tail is not None:
                rows = tuple(np.concatenate(x) for x in zip(tail, rows, strict=True))
            skip = 0 if tail is None else len(tail[0])
            k, ids, comp = rows
            for o in range(1, width + 1):
                if len(ids) > o:
                    near = (k[o:, : 1 + 4 * least] == k[:-o, : 1 + 4 * least]).all(1) & (comp[o:] != comp[:-o])
                    near[: max(0, skip - o)] = False
                    x, y = ids[o:][near], ids[:-o][near]
                    if len(x):
                        none = pa.nulls(len(x), pa.binary())
                        yield batch(PAIR, [np.minimum(x, y), np.maximum(x, y), np.full(len(x), -1, np.int32), none, pa.nulls(len(x), pa.int64())])
            tail = tuple(x[-width:] for x in rows)
        ends = [(*r, 2 * part) for r in head] + ([(*r, 2 * part + 1) for r in zip(*tail, strict=True)] if tail is not None else [])
        if ends:
            yield batch(PAIR, [[int(r[1]) for r in ends], [0] * len(ends), [r[3] for r in ends], [r[0].tobytes() for r in ends], [int(r[2]) for r in ends]])

    return run


def candidates(scratch: Scratch, rows: DataFrame, width: int, least: int) -> DataFrame:
    """Distinct pairs (a, b) of neighbours in the sorted orders, also across the ends of partitions."""
    # Without a number of parts, Spark joins short neighbouring ones: each part is a file, and for each file a JVM starts a process.
    ordered = rows.repartitionByRange("k", "id").sortWithinPartitions("k", "id")
    found = scratch.keep(ordered.mapInArrow(tidy(neighbours(width, least)), PAIR_SQL))
    # At most 2 * width rows of each partition, whatever the table: one task has all ends, so short partitions lose nothing.
    ends = found.where("edge >= 0").select("k", F.col("a").alias("id"), "comp").distinct()
    across = ends.repartition(1).sortWithinPartitions("k", "id").mapInArrow(tidy(neighbours(width, least)), PAIR_SQL)
    pairs = found.where("edge < 0").select("a", "b").unionByName(across.where("edge < 0").select("a", "b"))
    return pairs.where("a <> b").distinct()


def confirmer(words: int, over: int):
    """(a, b, text of a, text of b) -> the pairs with 100 * intersection >= over * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import EDGE

        seen, last = WordHash(), (None, None)
        for b in batches:
            a_ids, b_ids, xs, ys = [], [], [], []
            for a, c, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), texts(b.column(3)), strict=True):
                if last[0] != c:
                    last = (c, shingles(y, words, seen))
                s, t = shingles(x, words, seen), last[1]
                if 100 * min(len(s), len(t)) >= over * max(len(s), len(t)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= over * (len(s) + len(t) - both):
                        a_ids.append(a)
                        b_ids.append(c)
            if a_ids:
                yield batch(EDGE, [a_ids, b_ids])

    return run


def opened(crowded: DataFrame, comps: DataFrame, least: int) -> DataFrame:
    """(id, comp) of the documents whose prefix of least values holds several components and more rows than were all compared."""
    rows = crowded.select(F.xxhash64(F.substring("k", 1, 1 + 4 * least)).alias("p"), "id")
    rows = rows.join(comps.withColumnRenamed("node", "id"), "id", "left").select("p", "id", F.coalesce("comp", "id").alias("comp"))
    regions = rows.groupBy("p").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(f"lo <> hi and n > {WIDTH + 1}").select("p")
    return rows.join(regions, "p", "left_semi").select("id", "comp").distinct()


TALLY = pa.schema([("at", pa.int64()), ("n", pa.int64())])
HELD = pa.schema([("id", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64())), ("c", pa.binary())])


def counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(46)).astype(np.int64)


def tally(words: int):
    """Texts -> how many shingles fall on each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = WordHash(), np.zeros(COUNTERS, np.int64)
        for b in batches:
            for t in texts(b.column(0)):
                np.add.at(n, counter(shingles(t, words, seen)), 1)
        at = np.flatnonzero(n)
        if len(at):
            yield batch(TALLY, [at, n[at]])

    return run


def least_common(a, b, over: int):
    """Least intersection of sets of a and b shingles with 100 * intersection >= over * union."""
    return -(-over * (a + b) // (100 + over))


def rarest(words: int, over: int, shared):
    """(id, comp, text) -> the rarest shingles: as many as a set that reaches the limit with a smaller one must share one of, and those carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count = WordHash(), shared.value
        for b in batches:
            n, first, carried = [], [], []
            for t in texts(b.column(2)):
                s = shingles(t, words, seen)
                held = count[counter(s)]
                s = s[np.lexsort((s, held))]
                alone = int((held == 1).sum())  # no other document has these; they stand first
                n.append(len(s))
                most = len(s) + over * len(s) // -100 + 1
                first.append([None] * min(alone, most) + s[alone:most].view(np.int64).tolist())
                carried.append((s[:CARRIED] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            yield batch(HELD, [b.column(0), b.column(1), n, first, carried])

    return run


def comparer(over: int):
    """Rows (s, lo, hi, b, id, comp, n, at, c) sorted by s, lo, hi -> pairs of a group that may reach the limit, by bounds that hold."""

    def group(lo: int, hi: int, own: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, at: np.ndarray, c: list[bytes]):
        x = np.flatnonzero(own == lo)
        y = x if lo == hi else np.flatnonzero(own == hi)
        if not len(x) or not len(y):
            return None
        nx, ny = n[x][:, None], n[y][None, :]
        short, long = np.minimum(nx, ny), np.maximum(nx, ny)
        ok = (comp[x][:, None] != comp[y][None, :]) & (100 * short >= over * long)
        # The shared shingle is among the first of the smaller set too, where fewer are enough.
        ok &= np.where(nx <= ny, at[x][:, None], at[y][None, :]) <= short - least_common(short, short, over)
        if lo == hi:
            ok &= ids[x][:, None] < ids[y][None, :]
        if not ok.any():
            return None
        lens = np.array([len(v) // 4 for v in c])
        row = np.repeat(np.arange(len(c)), lens)
        _, col, many = np.unique(np.frombuffer(b"".join(c), np.uint32), return_inverse=True, return_counts=True)
        use = many > 1
        new = np.cumsum(use) - 1
        row, col = row[use[col]], new[col[use[col]]]
        both, step = np.zeros((len(x), len(y)), np.float32), 2048
        for k in range(0, int(use.sum()), step):
            part = (col >= k) & (col < k + step)
            m = np.zeros((len(c), step), np.float32)
            np.add.at(m, (row[part], col[part] - k), 1)
            both += m[x] @ m[y].T
        # Sets that share `need` have at least `deep` of it in common among the shingles carried, if these reach so far.
        need = least_common(nx, ny, over)
        deep = np.minimum(lens[x][:, None] - nx, lens[y][None, :] - ny) + need
        i, j = np.nonzero(ok & (both >= deep))
        return np.minimum(ids[x[i]], ids[y[j]]), np.maximum(ids[x[i]], ids[y[j]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import EDGE

        held: list[pa.RecordBatch] = []

        def ended() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            cols = [np.asarray(t.column(k)) for k in range(3, 8)]
            found = group(t.column(1)[0].as_py(), t.column(2)[0].as_py(), *cols, t.column(8).to_pylist())
            if found is not None and len(found[0]):
                yield batch(EDGE, list(found))

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([np.asarray(b.column(k)).astype(np.int64) for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, e in zip(cuts, cuts[1:]):
                if held and tuple(key[a]) != last:
                    yield from ended()
                    held.clear()
                last = tuple(key[a])
                held.append(b.slice(a, e - a))
        if held:
            yield from ended()

    return run


def settle(scratch: Scratch, members: DataFrame, gathered: DataFrame, words: int, over: int) -> DataFrame:
    """Pairs (a, b) of members of different components, none missing that reaches the limit; to be confirmed.

    A shingle that many rows share is dealt by pairs of blocks of its rows, so no task gets all of them.
    """
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = scratch.keep(gathered.join(members.hint("merge"), "id").select("id", "comp", "text"))
    count = np.zeros(COUNTERS, np.int64)
    tallied = src.select("text").mapInArrow(tidy(tally(words)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for r in tallied.coalesce(FETCHED).toLocalIterator():  # COUNTERS rows at most; each part is a job of the driver
        count[r["at"]] = r["n"]
    shared = spark.sparkContext.broadcast(count)
    held = scratch.keep(src.mapInArrow(tidy(rarest(words, over, shared)), "id long, comp long, n long, s array<long>, c binary"))
    thin = held.select("id", "comp", "n", F.posexplode("s").alias("at", "s")).where("s is not null")
    met = thin.groupBy("s").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("s", F.ceil(F.col("m") / BLOCK).cast("int").alias("g"))
    rows = thin.join(met, "s").withColumn("b", F.pmod(F.xxhash64("id"), F.col("g")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("s", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "id", "comp", "n", F.col("at").cast("long").alias("at"))
    rows = rows.join(held.select("id", "c"), "id").select("s", "lo", "hi", "b", "id", "comp", "n", "at", "c")
    dealt = rows.repartition(parts, "s", "lo", "hi").sortWithinPartitions("s", "lo", "hi")
    return dealt.mapInArrow(tidy(comparer(over)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, over: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: documents with 100 * intersection >= over * union are linked.

    Nulls and texts without words have no shingles and are linked with nothing. A null id has a null component and is
    kept. Rows that repeat an id with its text share a component; an id that repeats with other texts is one node, whose
    links are those of its smallest text. An empty table gives an empty result. Other columns
    are ignored. The links looked at are those of the module's docstring; each is confirmed on whole sets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    least = LEAST if over >= LOOSE else LEAST_LOOSE
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.keep(src.mapInArrow(tidy(signer(words)), "id long, n long, c binary, sig binary"))
    real = signed.where("c is not null and id is not null")
    reps = scratch.keep(real.groupBy("c").agg(F.min("id").alias("rep"), F.min_by("sig", "id").alias("sig")))
    short = reps.select(F.col("rep").alias("id"), "sig")

    # Only documents with a neighbour in some order can have links; their texts are gathered once.
    first = scratch.keep(short.select("id", "sig", F.col("id").alias("comp")).mapInArrow(tidy(keys(range(TREES))), "k binary, id long, comp long"))
    prefix = F.xxhash64(F.substring("k", 1, 1 + 4 * least))
    shared = first.groupBy(prefix.alias("p")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("p")
    crowded = scratch.keep(first.withColumn("p", prefix).join(shared, "p", "left_semi").select("k", "id", "comp"))
    scratch.drop(first)
    near_ids = crowded.select("id").distinct()
    gathered = scratch.keep(src.where("id is not null").join(near_ids.hint("merge"), "id", "left_semi"))
    scratch.sweep()
    # One row of each id is enough.
    gathered = gathered.groupBy("id").agg(F.min("text").alias("text")) if repeated(signed) else gathered

    def confirm(pairs: DataFrame) -> DataFrame:
        x, y = gathered.select(F.col("id").alias("a"), F.col("text").alias("ta")), gathered.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(tidy(confirmer(words, over)), "a long, b long")

    few = crowded.where(F.conv(F.hex(F.substring("k", 1, 1)), 16, 10).cast("int") < FIRST)
    links = scratch.keep(confirm(candidates(scratch, few, 1, least)))
    comps = components(scratch, links)
    labelled = crowded.drop("comp").join(comps.withColumnRenamed("node", "id"), "id", "left").select("k", "id", F.coalesce("comp", "id").alias("comp"))
    more = scratch.keep(confirm(candidates(scratch, labelled, WIDTH, least)))
    comps = components(scratch, union([links, more]))
    members = scratch.keep(opened(crowded, comps, least))
    if members.limit(1).count():
        rest = scratch.keep(confirm(settle(scratch, members, gathered, words, over)))
        comps = components(scratch, union([links, more, rest]))
    classes = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("c", F.coalesce("comp", "rep").alias("comp"))
    out = signed.select("id", "n", "c").join(classes, "c", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    scratch.sweep()
    return out


def repeated(signed: DataFrame) -> bool:
    """Whether any id stands in two rows."""
    return bool(signed.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count())


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("component_id", T.LongType()), T.StructField("kept", T.BooleanType())])
