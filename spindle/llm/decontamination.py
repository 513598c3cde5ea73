"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF; document frequencies are those of the whole corpus, counted
in a sketch of fixed size that never counts too few. Windows of every document are looked at whose weight is carried, to a
least share, by the items' words. The items' passages and the text of all these windows, of all documents, are factorised
by a randomised SVD whose products A'(A X) are summed over partitions; its rank is well below the number of passages, so
that words that stand in the same passages stand for each other. The items' words have a row of the space each, all other
words share OTHERS rows by hash. The windows are projected into this latent space; those whose cosine with a passage
reaches a threshold are candidates. A candidate is a leak if the longest common subsequence of the item and the text
around the window covers enough of the item; below a near-verbatim share, the item's answer must be covered as well.

The windows and the text around them are kept as codes, so a block of items reads the corpus once, and what is fitted is
what is searched. Items are handled in blocks of a fixed size, so what is broadcast is bounded whatever the benchmark's
size; the corpus is counted once for all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, mix, release, release_driver, tidy, union

#: Items of a block; latent dimensions; words of passages (an item takes the largest that it fills).
BLOCK, RANK, WIDTHS = 2000, 192, (16, 32, 64)
#: Counters of the sketch, dealt in slices; rows of the latent space for words that the items don't have.
COUNTERS, SLICE, OTHERS = 1 << 20, 1 << 14, 1 << 15
#: Rows of the latent space that the driver fetches at once.
PART = 1 << 13
#: As many of the corpus' passages as weigh together what all of them do, so that the items' own count however large the
#: corpus is; tasks that go over them at least, passages of a task.
WEIGHT, TASKS, MANY = 2000, 4, 1_000_000
#: Least share of a window's weight that the items' words must carry.
ABLE = 0.42
#: Least cosine of a candidate; least share of an item in a leak, share from which the answer is not asked for, and the answer's.
COSINE, SHARE, VERBATIM, ANSWER = 0.6, 0.6, 0.85, 0.5
_TABLE = bytes(32 if b < 33 or chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    return lowered(text).split()


def width(n: int) -> int:
    return next((w for w in WIDTHS[::-1] if w <= n), WIDTHS[0])


def passages(item: list[int]) -> list[list[int]]:
    w = width(len(item))
    if len(item) <= w + w // 2:
        return [item]
    return [item[at : at + w] for at in [*range(0, len(item) - w, w), len(item) - w]]


def subsequence(marks: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence of a text and an item, given the item's positions of each word."""
    full = (1 << size) - 1
    v = full
    for x in text:
        if (m := marks.get(x)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def positions(item: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, x in enumerate(item):
        out[x] = out.get(x, 0) | 1 << k
    return out


def orthonormal(y: np.ndarray, step: int = 4096) -> np.ndarray:
    """Orthonormal columns that span those of y, largest first, zeros for what y's rank lacks; made from y'y, a few rows
    at a time, in y's place: the driver holds no copy in double precision."""
    parts = range(0, len(y), step)
    values, turn = np.linalg.eigh(sum((z.T @ z for z in (y[at : at + step].astype(np.float64) for at in parts)), np.zeros((y.shape[1],) * 2)))
    values, turn = values[::-1], turn[:, ::-1]
    keep = values > values[0] * 1e-12
    turn = turn * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)
    for at in parts:
        y[at : at + step] = y[at : at + step].astype(np.float64) @ turn
    return y


def leading(x: np.ndarray, rank: int, step: int = 4096) -> np.ndarray:
    """The first columns of x, moved together in x's own memory: what is sent from there needs no copy."""
    flat = x.reshape(-1)
    for at in range(0, len(x), step):
        part = x[at : at + step, :rank].copy()
        flat[at * rank : at * rank + part.size] = part.reshape(-1)
    return flat[: len(x) * rank].reshape(len(x), rank)


VECTOR = pa.schema([("i", pa.binary()), ("w", pa.binary()), ("scale", pa.float64())])
VECTOR_SQL = "i binary, w binary, scale double"


def randomised_basis(spark, vectors: list[tuple[np.ndarray, np.ndarray]], size: int, rank: int, rounds: int = 3, more: DataFrame | None = None, scale: float = 1.0, tasks: int = TASKS) -> np.ndarray:
    """Orthonormal basis (size x rank) of the leading row space of sparse vectors, by subspace iteration from random columns.

    The vectors are dealt over partitions; each round every partition gives its share of A'(A X), and the shares are summed.
    more: further vectors as (i: int32s, w: float32s), whose products count scale times.
    """
    rank = max(1, min(rank, len(vectors) if more is None else size, size))
    x = orthonormal(np.random.default_rng(8).standard_normal((size, min(size, rank + 8)), np.float32))
    own = pa.table([[v[0].astype(np.int32).tobytes() for v in vectors], [v[1].astype(np.float32).tobytes() for v in vectors], [1.0] * len(vectors)], schema=VECTOR)
    rows = spark.createDataFrame(own).repartition(1 + len(vectors) // 1000)
    if more is not None:
        rows = rows.unionByName(more.select("i", "w", F.lit(scale).alias("scale")).coalesce(tasks))
    schema = pa.schema([("at", pa.int64()), ("y", pa.binary())])
    step, wide = 512, x.shape[1]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(x)
        x = None  # the driver holds one of x and y
        release()
        spark.sparkContext._jvm.System.gc()  # and its JVM little of the round before
        release_driver(spark)

        def share(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x = shared.value
            y = np.zeros_like(x)
            for b in batches:
                for lo in range(0, b.num_rows, 16):  # so few share one small dense product
                    i, w, scale = (c.slice(lo, 16).to_pylist() for c in b.columns)
                    lens = [len(v) // 4 for v in i]
                    met, col = np.unique(np.frombuffer(b"".join(i), np.int32), return_inverse=True)
                    m = np.zeros((len(lens), len(met)), np.float32)
                    m[np.repeat(np.arange(len(lens)), lens), col] = np.frombuffer(b"".join(w), np.float32)
                    y[met] += (m * np.array(scale, np.float32)[:, None]).T @ (m @ x[met])
            for at in range(0, size, step):
                yield batch(schema, [[at], [y[at : at + step].tobytes()]])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for at, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    y = np.frombuffer(y, np.float32)
                    held[at] = held[at] + y if at in held else y
            for at, y in held.items():
                yield batch(schema, [[at], [y.tobytes()]])

        y = np.zeros((size, wide), np.float32)
        # size / step rows, whatever the corpus; each part is a job of the driver and comes to it at once, so parts are few and small
        for at, part in rows.mapInArrow(tidy(share), "at long, y binary").repartition("at").coalesce(-(-size // PART)).mapInArrow(tidy(add), "at long, y binary").toLocalIterator():
            y[at : at + step] = np.frombuffer(part, np.float32).reshape(-1, wide)
        shared.destroy()  # the driver's copy goes too
        release()
        x, y = orthonormal(y), None
    return leading(x, rank)


SLICES = pa.schema([("at", pa.int64()), ("n", pa.binary())])


def counters(h: np.ndarray) -> np.ndarray:
    """The counters of words' hashes."""
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def counter(word: bytes) -> int:
    return int(counters(hashed(word)[0])[0])


#: Of a word's hash: the values of its bytes, the base that gives their places, bytes hashed at once.
_rng = np.random.default_rng(88)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE, PIECE = int(_rng.integers(1, 2**63)) | 1, 1 << 17


@lru_cache(2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers, and their inverses, modulo 2^64."""
    return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of each word of data, whose words are parted by blanks."""
    found, places, a = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while a < len(data):
        e = data.rfind(b" ", a, a + PIECE) + 1 if len(data) - a > PIECE else len(data)
        if not e:  # a word as long as this
            e = data.find(b" ", a + PIECE) + 1 or len(data)
        b = np.frombuffer(b" " + data[a:e] + b" ", np.uint8)
        edges = np.flatnonzero(np.diff(b != 32))
        first, last = edges[::2], edges[1::2]
        up, down = powers(1 << max(PIECE.bit_length(), len(b).bit_length()))
        sums = np.cumsum(_VALUES[b] * up[: len(b)], dtype=np.uint64)
        found.append(mix((sums[last] - sums[first]) * down[first]))
        places.append(first + a)
        a = e
    return np.concatenate(found), np.concatenate(places)


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE)


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, where each text's begin and the last one's end)"""
    data = [lowered(t) for t in texts]
    h, place = hashed(b" ".join(data))
    return h, np.searchsorted(place, np.cumsum([0, *(len(x) + 1 for x in data)]))


class Codes:
    """Words -> their numbers in a vocabulary, or else the vocabulary's size and their counter."""

    def __init__(self, vocabulary: dict[bytes, int]):
        h, _ = hashed(b" ".join(vocabulary))
        order = np.argsort(h)
        self.hashes, self.numbers, self.base = h[order], np.array(list(vocabulary.values()), np.int64)[order], len(vocabulary)
        self.taken = np.zeros(COUNTERS, bool)  # counters on which words of the vocabulary are
        self.taken[counters(h)] = True

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the words of all texts, where each text's begin and the last one's end)"""
        h, begin = hashes(texts)
        at = counters(h)
        maybe = np.flatnonzero(self.taken[at])
        at += self.base
        k = np.minimum(np.searchsorted(self.hashes, h[maybe]), self.base - 1)
        same = self.hashes[k] == h[maybe]
        at[maybe[same]] = self.numbers[k[same]]
        return at, begin


def slots(at: np.ndarray, own: int) -> np.ndarray:
    """Rows of the latent space of codes: the items' words have their own, others one by their counter."""
    return np.where(at < own, at, own + (at - own) % OTHERS)


def frequencies(src: DataFrame) -> tuple[np.ndarray, int]:
    """(documents on each counter of words, documents): a word is in at most as many documents as its counter says."""
    size, step = COUNTERS, SLICE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs, mark = np.zeros(size, np.int64), 0, np.zeros(size, np.int32)
        for b in batches:
            for rows in groups(b):
                h, begin = hashes([r[0] for r in rows])
                at = counters(h)
                docs += len(rows)
                for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist()):
                    # a document counts once on a counter: for the last of its words there
                    met, order = at[lo:hi], np.arange(hi - lo, dtype=np.int32)
                    mark[met] = order
                    n[met[mark[met] == order]] += 1
        if docs:
            yield batch(SLICES, [[*range(0, size, step), size], [*(n[at : at + step].tobytes() for at in range(0, size, step)), np.array([docs]).tobytes()]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.frombuffer(n, np.int64)
                held[at] = held[at] + n if at in held else n
        if held:
            yield batch(SLICES, [list(held), [n.tobytes() for n in held.values()]])

    out, docs = np.zeros(size, np.int64), 0
    # size / step + 1 rows, whatever the corpus
    for at, n in src.select("text").mapInArrow(tidy(count), "at long, n binary").repartition("at").mapInArrow(tidy(add), "at long, n binary").collect():
        n = np.frombuffer(n, np.int64)
        if at == size:
            docs = int(n[0])
        else:
            out[at : at + step] = n
    return out, docs


def groups(b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows of a batch whose last column is a text, about so many characters at a time."""
    held, size = [], 0
    for at in range(0, b.num_rows, 500):
        for row in zip(*(c.slice(at, 500).to_pylist() for c in b.columns), strict=True):
            held.append(row)
            size += len(row[-1] or "")
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def grid(begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, text) of the windows of texts whose words begin at begin[:-1]: each quarter of a width, and a text's last."""
    n, step = np.diff(begin), size // 4
    many = np.where(n > 0, -(-np.maximum(1, n - size + 1) // step) + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    upto = np.cumsum(many)
    first = (np.arange(len(text)) - (upto - many)[text]) * step
    first[upto[many > 0] - 1] = np.maximum(0, n - size)[many > 0]
    return begin[text] + first, begin[text] + np.minimum(first + size, n[text]), text


def covered(first: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which of size places lie in some window."""
    held = np.zeros(size + 1, np.int64)
    np.add.at(held, first, 1)
    np.add.at(held, end, -1)
    return np.cumsum(held[:-1]) > 0


def weights(vocabulary: dict[bytes, int], idf: np.ndarray) -> np.ndarray:
    """The weight of each code."""
    return np.concatenate((idf[counters(hashed(b" ".join(vocabulary))[0])], idf)).astype(np.float32)


REGION = pa.schema([("id", pa.int64()), ("codes", pa.binary()), ("windows", pa.binary())])


def regions(spark, src: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, near: dict[int, int]) -> DataFrame:
    """(id, codes, windows): for each document with a window, of a width of near, in which the items' words carry the least
    share of the weight, the codes of these windows and of near[width] words on either side, and the windows as (width,
    first, end) in these."""
    known, able = spark.sparkContext.broadcast((vocabulary, idf)), ABLE

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf = known.value
        codes, own = Codes(vocabulary), len(vocabulary)
        weight = weights(vocabulary, idf) ** 2
        for b in batches:
            for rows in groups(b):
                at, begin = codes.of([r[1] for r in rows])
                x = weight[at]
                inside, total = (np.concatenate(([0.0], np.cumsum(y, dtype=np.float64))) for y in (np.where(at < own, x, 0), x))
                found, around = [], []
                for size, more in near.items():
                    first, end, text = grid(begin, size)
                    ok = inside[end] - inside[first] >= able * (total[end] - total[first])
                    first, end, text = first[ok], end[ok], text[ok]
                    found.append((np.full(len(first), size), first, end, text))
                    around.append((np.maximum(begin[text], first - more), np.minimum(begin[text + 1], end + more)))
                size, first, end, text = (np.concatenate(c) for c in zip(*found, strict=True))
                if not len(first):
                    continue
                held = covered(*(np.concatenate(c) for c in zip(*around, strict=True)), len(at))
                place = np.concatenate(([0], np.cumsum(held)))
                own_text = place[begin]
                windows = np.stack((size, place[first] - own_text[text], place[end] - own_text[text]), 1).astype(np.int32)
                order = np.argsort(text, kind="stable")
                windows, text = windows[order], text[order]
                met = at[held].astype(np.int32)
                cuts = [0, *(np.flatnonzero(np.diff(text)) + 1).tolist(), len(text)]
                which = text[cuts[:-1]].tolist()
                yield batch(REGION, [[rows[k][0] for k in which], [met[own_text[k] : own_text[k + 1]].tobytes() for k in which], [windows[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])]])

    return Scratch(spark).keep(src.select("id", "text").mapInArrow(tidy(find), "id long, codes binary, windows binary"))


MATCH = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64())])


def searcher(shared):
    """(id, codes, windows) of regions() -> the items that leak into each text, with the cosine and the share of their best window."""

    def one(at: np.ndarray, windows: np.ndarray, s: dict) -> dict[int, tuple[float, float]]:
        found: dict[int, tuple[float, float]] = {}
        for size, (latent, items) in s["passages"].items():
            starts, ends = windows[windows[:, 0] == size, 1:].T
            for lo in range(0, len(starts), 2000):  # a few windows at a time, however long the text
                first, last = starts[lo : lo + 2000], ends[lo : lo + 2000]
                held = covered(first - first[0], last - first[0], last[-1] - first[0])
                place = np.concatenate(([0], np.cumsum(held)))
                met = at[first[0] : last[-1]][held]
                sums = np.cumsum(s["basis"][slots(met, s["own"])] * s["scale"][met, None], axis=0)
                sums = np.concatenate((np.zeros((1, sums.shape[1]), np.float32), sums))
                v = sums[place[last - first[0]]] - sums[place[first - first[0]]]
                cosines = v @ latent.T / (np.sqrt((v * v).sum(1, keepdims=True)) + 1e-12)
                for k, j in zip(*(x.tolist() for x in np.nonzero(cosines >= s["cosine"])), strict=True):
                    item, a, e = items[j], int(first[k]), int(last[k])
                    if item in found and found[item][1] >= 1:
                        continue
                    marks, m, answer, am = s["items"][item]
                    around = at[max(0, a - m) : e + m].tolist()
                    if sum(marks[x].bit_count() for x in marks.keys() & set(around)) < SHARE * m:
                        continue
                    share = subsequence(marks, m, around) / m
                    if share >= SHARE and (share >= VERBATIM or subsequence(answer, am, around) >= ANSWER * am):
                        best = found.get(item, (0.0, 0.0))
                        found[item] = (max(best[0], float(cosines[k, j])), max(best[1], share))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            out: list[tuple] = []
            for i, at, windows in zip(*b.columns, strict=True):
                at, windows = np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(windows.as_buffer(), np.int32).reshape(-1, 3)
                out += [(i.as_py(), item, c, share) for item, (c, share) in one(at.astype(np.int64), windows.astype(np.int64), s).items()]
            if out:
                yield batch(MATCH, list(zip(*out, strict=True)))

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """(id, item, cosine, share): a row for each document and item that leaks into it.

    answer_col: a column with the item's answer; without one, the last quarter of the item is what is asked for. Null
    and empty texts, items without words and rows with a null id match nothing. Rows that repeat an id with its text
    give equal rows; an item id that repeats with other texts counts by the last of them. Other columns are ignored.
    Empty tables give none. The latent space is fitted on the items and on all windows searched, of all documents.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"), (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer")).where("item is not null")
    counts, docs_n = frequencies(src)
    idf = (np.log((docs_n + 1) / (np.minimum(counts, docs_n) + 1)) + 1).astype(np.float32)
    del counts
    found, block = [], []
    # one sorted file, of which the driver reads a row group or so at a time: a job each, not one for each part of a shuffle
    for r in Scratch(spark).keep(items.coalesce(1).sortWithinPartitions("item", "text")).toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            found.append(search(spark, src, block, idf))
            block = []
    if block or not found:
        found.append(search(spark, src, block, idf))
    return union(found)


def related(spark, src: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, found: DataFrame | None = None) -> DataFrame:
    """(i, w): the distinct passages of all windows of regions() (found, if these are made already) of all documents, as
    vectors of the latent space's rows: a word that is searched is in the fit."""
    found = regions(spark, src, vocabulary, idf, dict.fromkeys(WIDTHS, 0)) if found is None else found
    known, width_, own = spark.sparkContext.broadcast(weights(vocabulary, idf)), WIDTHS[1], len(vocabulary)
    schema = pa.schema([("i", pa.binary()), ("w", pa.binary())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, rows = known.value, own + OTHERS
        for b in batches:
            out: set[tuple[bytes, bytes]] = set()
            for lo in range(0, b.num_rows, 500):
                codes, windows = (c.slice(lo, 500).to_pylist() for c in b.columns)
                at = np.frombuffer(b"".join(codes), np.int32).astype(np.int64)
                begin = np.cumsum([0, *(len(x) // 4 for x in codes)])
                seen = np.frombuffer(b"".join(windows), np.int32).reshape(-1, 3)[:, 1:] + np.repeat(begin[:-1], [len(x) // 12 for x in windows])[:, None]
                held = np.flatnonzero(covered(seen[:, 0], seen[:, 1], len(at)))
                # a passage begins where a run or a text does, and after so many words
                run = np.diff(held, prepend=-2) > 1
                run[np.unique(np.searchsorted(held, begin[:-1]))] = True
                heads = np.flatnonzero(run)
                inside = np.arange(len(held)) - heads[np.cumsum(run) - 1]
                passage = np.cumsum(inside % width_ == 0) - 1
                key, place = np.unique(passage * rows + slots(at[held], own), return_inverse=True)
                i, w = (key % rows).astype(np.int32), np.bincount(place, weight[at[held]]).astype(np.float32)
                cuts = np.searchsorted(key // rows, np.arange(passage[-1] + 2)) * 4
                i, w = i.tobytes(), w.tobytes()
                out.update((i[x:y], w[x:y]) for x, y in pairwise(cuts.tolist()))
            if out:
                yield batch(schema, list(zip(*out, strict=True)))

    return Scratch(spark).keep(found.select("codes", "windows").mapInArrow(tidy(pick), "i binary, w binary").distinct())


def search(spark, src: DataFrame, block: list, idf: np.ndarray) -> DataFrame:
    """leaks() for a block of items."""
    vocabulary: dict[bytes, int] = {}
    held = []
    for r in block:
        w = [vocabulary.setdefault(x, len(vocabulary)) for x in words(r["text"])]
        answer = [vocabulary.setdefault(x, len(vocabulary)) for x in words(r["answer"])] or w[-max(1, len(w) // 4) :]
        if w:
            held.append((r["item"], w, answer))
    if not held:
        return src.sparkSession.createDataFrame([], "id long, item long, cosine double, share double")
    own = len(vocabulary)
    sizes = [len(w) for _, w, _ in held]
    near = {wide: max(n for n in sizes if width(n) == wide) for wide in WIDTHS if any(width(n) == wide for n in sizes)}
    found = regions(spark, src, vocabulary, idf, near)
    others = related(spark, src, vocabulary, idf, found)
    weight = weights(vocabulary, idf)

    cut, vectors = [], []
    for item, w, _ in held:
        for p in passages(w):
            at, tf = np.unique(np.array(p), return_counts=True)
            vectors.append((at, tf * weight[at]))
            cut.append((width(len(w)), item))
    n = others.count()
    Scratch(spark).sweep()
    basis = randomised_basis(spark, vectors, own + OTHERS, min(RANK, len(vectors) + n), more=others, scale=min(1.0, WEIGHT / max(1, n)), tasks=max(TASKS, n // MANY))
    by_width: dict[int, tuple] = {}
    for wide in WIDTHS:
        mine = [k for k, (x, _) in enumerate(cut) if x == wide]
        if mine:
            latent = np.array([vectors[k][1].astype(np.float32) @ basis[vectors[k][0]] for k in mine])
            by_width[wide] = (latent / (np.linalg.norm(latent, axis=1, keepdims=True) + 1e-12), [cut[k][1] for k in mine])
    marks = {item: (positions(w), len(w), positions(a), len(a)) for item, w, a in held}
    shared = spark.sparkContext.broadcast({"own": own, "scale": weight, "basis": basis, "passages": by_width, "items": marks, "cosine": COSINE})
    del basis, vectors, others
    release()
    release_driver(spark)
    return found.mapInArrow(tidy(searcher(shared)), "id long, item long, cosine double, share double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """(id, contaminated, item_ids, share) for each row; item_ids sorted, empty and share 0 where nothing leaks. Rows
    with a null id are not contaminated."""
    hits = leaks(docs, benchmark, id_col, text_col, **names).groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("share").alias("share"))
    out = docs.select(F.col(id_col).cast("long").alias("id")).join(hits, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))
