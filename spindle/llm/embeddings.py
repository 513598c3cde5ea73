"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction of a product code: the space is rotated and split into blocks, each with its own random code
words, and a direction is one word of each. A vector's filters are all directions whose inner product with it exceeds a
threshold; they are list-decoded block by block, leaving out prefixes that can't reach it any more. Vectors are joined
on filters, and pairs within a filter are verified in double precision. The code follows the number of vectors: a filter
should hold a few dozen of them, and a pair at the least cosine should share SHARED filters on average.

Equal vectors are one class. A filter with many vectors is split into pieces, and pairs of pieces are compared; a pair
counts only in the first filter that it shares, so that counts need no list of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EDGE, Scratch, batch, components, tidy

#: Vectors that a filter should hold, filters of a code that a pair at the least cosine should share, vectors of a piece.
HELD, SHARED, PIECE = 50, 9, 1024
#: Codes with rotations of their own: a pair whose difference lies badly for one seldom does for the other.
CODES = 2
#: A cosine this much below the limit is computed again, vector by vector.
SLACK = 1e-9


@lru_cache(8)
def code(d: int, n: int, cosine: float, which: int = 0) -> tuple[np.ndarray, list[np.ndarray], float]:
    """(rotation, code words of each block, threshold of the sum of block products) for n vectors of d dimensions."""
    u = np.linspace(-1, 1, 200_001)[1:-1]
    density = (1 - u * u) ** ((d - 3) / 2) if d > 1 else np.ones(len(u))
    tail = np.cumsum(density[::-1])[::-1] / density.sum()
    p = min(0.25, HELD / max(1, n))
    alpha = float(min(0.95, u[np.searchsorted(-tail, -p)]))
    excess = (1 - alpha * alpha) / max(1.0, d * alpha)
    side = math.sqrt(1 - cosine * cosine) * math.sqrt((1 - alpha * alpha) / max(1, d - 1))
    q = 0.5 * math.erfc((alpha - cosine * (alpha + excess)) / max(side, 1e-9) / math.sqrt(2))
    want = SHARED / (max(p, float(tail[np.searchsorted(u, alpha)])) * max(q, 0.05))
    m = next((m for m in range(1, d + 1) if want ** (1 / m) <= 200), d)
    k = max(2, math.ceil(want ** (1 / m)))
    rng = np.random.default_rng([2, d, n.bit_length(), which])
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    words = []
    for part in np.array_split(np.arange(d), m):
        w = rng.standard_normal((k, len(part)))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True))
    return rotation, words, alpha * math.sqrt(m)


def decode(x: np.ndarray, words: list[np.ndarray], least: float) -> np.ndarray:
    """All directions of the code whose product with x reaches the threshold, as sorted numbers."""
    parts, at = [], 0
    for w in words:
        parts.append(w @ x[at : at + w.shape[1]])
        at += w.shape[1]
    rest = np.append(np.cumsum([s.max() for s in parts[::-1]])[::-1], 0.0)
    number, total = np.zeros(1, np.int64), np.zeros(1)
    for k, s in enumerate(parts):
        total = (total[:, None] + s[None, :]).ravel()
        number = (number[:, None] * len(s) + np.arange(len(s))[None, :]).ravel()
        keep = total + rest[k + 1] >= least
        number, total = number[keep], total[keep]
    return number


CLEAN = pa.schema([("id", pa.int64()), ("c", pa.binary()), ("x", pa.binary())])


def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as doubles, with a digest; both null where a vector links with nothing."""
    for b in batches:
        digests, vectors = [], []
        for v in b.column(1):
            x = v.values if v.is_valid else None
            a = None if x is None or x.null_count or not len(x) else np.ascontiguousarray(x.to_numpy(zero_copy_only=False), dtype=np.float64)
            good = a is not None and bool(np.isfinite(a).all()) and bool(a.any())
            a = a + 0.0 if good else a  # one zero, not two
            digests.append(xxhash.xxh3_128_digest(a.tobytes()) if good else None)
            vectors.append(a.astype(np.float32).tobytes() if good and (a.astype(np.float32) == a).all() else b"d" + a.tobytes() if good else None)
        yield batch(CLEAN, [b.column(0), digests, vectors])


def vector(x: bytes) -> np.ndarray:
    return np.frombuffer(x[1:], np.float64) if len(x) % 4 else np.frombuffer(x, np.float32).astype(np.float64)


def units(xs: list[bytes]) -> np.ndarray:
    """unit() of vectors that are packed alike."""
    if len(xs[0]) % 4:
        return np.array([unit(vector(x)) for x in xs])
    v = np.frombuffer(b"".join(xs), np.float32).reshape(len(xs), -1).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()  # so that squares neither overflow nor vanish
    return v / math.sqrt(float(v @ v))


FILTERED = pa.schema([("f", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("x", pa.binary()), ("fs", pa.binary())])
FILTERED_SQL = "f long, id long, n long, x binary, fs binary"


def numbers(fs: bytes) -> np.ndarray:
    """A vector's filters, sorted, as packed by filterer(): four bytes each where that is enough."""
    return np.frombuffer(fs[1:], np.uint32 if fs[:1] == b"4" else np.int64).astype(np.int64)


def filterer(count: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in FILTERED]
            for i, n, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = unit(vector(x))
                each = []
                for which in range(CODES):
                    rotation, words, least = code(len(v), count, cosine, which)
                    each.append(decode(rotation @ v, words, least) * CODES + which)
                found = np.sort(np.concatenate(each))
                fs = b"4" + found.astype(np.uint32).tobytes() if found.max(initial=0) < 1 << 32 else b"8" + found.tobytes()
                found = found * 4096 + len(v) % 4096  # vectors of other lengths don't meet
                for col, y in zip(cols, (found.tolist(), [i] * len(found), [n] * len(found), [x] * len(found), [fs] * len(found)), strict=True):
                    col += y
                if len(cols[0]) > 20_000:
                    yield batch(FILTERED, cols)
                    cols = [[] for _ in FILTERED]
            if cols[0]:
                yield batch(FILTERED, cols)

    return run


FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def earlier(fs_a: list[np.ndarray], fs_b: list[np.ndarray], f: int) -> np.ndarray:
    """Which pairs share a filter before f."""
    flat = np.concatenate([x[x < f] for x in fs_a + fs_b])
    names = np.unique(flat)
    if not len(names):
        return np.zeros((len(fs_a), len(fs_b)), bool)

    def marks(fs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(fs), len(names)), np.float32)
        for k, x in enumerate(fs):
            out[k, np.searchsorted(names, x[x < f])] = 1
        return out

    return marks(fs_a) @ marks(fs_b).T > 0


def compare(f: int, lo: int, hi: int, rows: list[tuple], cosine: float) -> Iterator[tuple[int, int, int]]:
    """One filter's piece against itself or another -> (id, vectors linked here first, smallest id of its part)."""
    a = [r for r in rows if r[3] == lo]
    b = a if lo == hi else [r for r in rows if r[3] == hi]
    if not a or not b:
        return
    if len({len(r[2]) for r in rows}) > 1:  # lengths 4096 apart, or doubles among floats
        va, vb = ([vector(r[2]) for r in x] for x in (a, b))
        lengths = {len(v) for v in va + vb}
        if len(lengths) > 1:  # compare each on its own
            for size in lengths:
                yield from compare(f, lo, hi, [r for r in rows if len(vector(r[2])) == size], cosine)
            return
        xa, xb = np.array([unit(v) for v in va]), np.array([unit(v) for v in vb])
    else:
        xa = units([r[2] for r in a])
        xb = xa if a is b else units([r[2] for r in b])
    near = xa @ xb.T
    mask = near >= cosine
    for i, j in np.argwhere(np.abs(near - cosine) < SLACK):
        v, w = vector(a[i][2]), vector(b[j][2])
        mask[i, j] = float(v @ w) / (math.sqrt(float(v @ v)) * math.sqrt(float(w @ w))) >= cosine
    if a is b:
        np.fill_diagonal(mask, False)
    if not mask.any():
        return
    one = a is b
    ka, kb = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    a, b, mask = [a[k] for k in ka], [b[k] for k in kb], mask[np.ix_(ka, kb)]
    f //= 4096
    new = mask & ~earlier([numbers(r[4]) for r in a], [numbers(r[4]) for r in b], f)
    na, nb = np.array([r[1] for r in a]), np.array([r[1] for r in b])
    links = [new @ nb] if one else [new @ nb, new.T @ na]
    la, lb = np.array([r[0] for r in a]), np.array([r[0] for r in b])
    ids, big = la if one else np.concatenate([la, lb]), np.iinfo(np.int64).max
    while True:
        ma = np.minimum(la, np.where(mask, lb[None, :], big).min(1))
        mb = ma if one else np.minimum(lb, np.where(mask, ma[:, None], big).min(0))
        if (ma == la).all() and (mb == lb).all():
            break
        la, lb = ma, mb
    roots = la if one else np.concatenate([la, lb])
    yield from zip(ids.tolist(), np.concatenate(links).tolist(), roots.tolist(), strict=True)


def comparer(cosine: float):
    """Rows (f, lo, hi, id, n, x, piece, fs), those of a comparison together -> what compare() finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for b in batches:
            for f, lo, hi, i, n, x, piece, fs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (f, lo, hi) != key:
                    if len(rows) > 1:
                        out += compare(*key, rows, cosine)
                    key, rows = (f, lo, hi), []
                rows.append((i, n, x, piece, fs))
            if len(out) > 10_000:
                yield batch(FOUND, list(zip(*out, strict=True)))
                out = []
        if len(rows) > 1:
            out += compare(*key, rows, cosine)
        if out:
            yield batch(FOUND, list(zip(*out, strict=True)))

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row: vectors with at least this cosine are linked.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors of
    different lengths. Each other row that is linked directly counts, so rows that repeat a vector count each other. An
    id that repeats with other vectors is one node: its rows share a component and the sum of their links. A
    null id has a null component and is kept. Empty tables give an empty result. Which links are found is a matter of
    chance with a chance of missing of about exp(-CODES * SHARED) at the least cosine; none below it is found.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = scratch.keep(src.mapInArrow(tidy(clean), "id long, c binary, x binary"))
    classes = scratch.keep(rows.where("c is not null and id is not null").groupBy("c").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("x").alias("x")))
    made = scratch.keep(classes.select("id", "n", "x").mapInArrow(tidy(filterer(classes.count(), cosine)), FILTERED_SQL))
    held = made.groupBy("f").agg(F.count("*").alias("held")).where("held > 1").withColumn("pieces", F.ceil(F.col("held") / PIECE).cast("int")).drop("held")
    dealt = made.join(held, "f").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("f", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), "id", "n", "x", "piece", "fs")
    met = dealt.repartition("f", "lo", "hi").sortWithinPartitions("f", "lo", "hi")
    found = scratch.keep(met.mapInArrow(tidy(comparer(cosine)), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(scratch, found.where("id <> root").select(F.col("id").alias(EDGE.names[0]), F.col("root").alias(EDGE.names[1])))
    whole = classes.select("c", "id", "n").join(links, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    whole = whole.select("c", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("comp", "id").alias("comp"))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("c")).alias("c")).join(whole, "c", "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
