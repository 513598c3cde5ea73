"""Toxicity by compression distance: windows of a text are compressed against two zstandard dictionaries.

Two dictionaries are made by zstandard's trainer: one of windows of ordinary documents, one of toxic text, which is
every use, in toxic documents, of words with pieces that these have far more often than ordinary ones do. Windows are
compressed with the ordinary dictionary, and with the toxic one in front of it: where the second is shorter by some
bytes, a window repeats toxic text. Both share the ordinary part, so that windows of ordinary text differ by nothing,
whatever language they are in. A document's windows cover all of its words; the calibrated threshold is a logistic
function of the differences' mean, largest values and counts, fitted on labelled documents that the dictionaries have
not seen.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, release_driver, texts, tidy, union

WINDOW = 10
#: Bytes of the ordinary dictionary and of the toxic one.
ORDINARY, TOXIC = 30_000, 6_000
#: Length of the pieces by which toxic words are recognised.
GRAM = 5
#: Ends every window and both dictionaries, so that every window has a match and costs the same to begin with.
PAD = bytes(range(1, 9)) + bytes(range(128, 136))


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: list[float]
    mean: list[float]
    scale: list[float]

    def compressors(self) -> list[zstd.ZstdCompressor]:
        made = zstd.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=4, target_length=64, strategy=zstd.STRATEGY_LAZY, write_content_size=False, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_dict_id=False)
        out = []
        for d in (self.ordinary + b" " + PAD, self.toxic + b" " + self.ordinary + b" " + PAD):
            d = zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=made)
            out.append(zstd.ZstdCompressor(compression_params=made, dict_data=d))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def gains(text: bytes, compressors: list[zstd.ZstdCompressor]) -> np.ndarray:
    """Bytes that each window is shorter with the toxic dictionary."""
    w = words(text)
    out = [np.zeros(0)]
    for at in range(0, len(w), 20_000 * WINDOW):
        part = w[at : at + 20_000 * WINDOW]
        windows = [b" ".join(part[i : i + WINDOW]) + PAD for i in range(0, len(part), WINDOW)]
        n = np.fromiter(map(len, windows), np.uint64, len(windows))
        data = zstd.BufferWithSegments(b"".join(windows), np.stack([np.cumsum(n) - n, n], 1).tobytes())
        sizes = []
        for c in compressors:
            made = c.multi_compress_to_buffer(data, threads=0)
            sizes.append(np.fromiter(map(len, map(made.__getitem__, range(len(made)))), np.int64, len(made)))
        out.append(sizes[0] - sizes[1])
    return np.concatenate(out)


def features(g: np.ndarray) -> list[float]:
    if not len(g):
        return [0.0] * 6
    top = np.sort(g)[-3:]
    many = (g >= 3).sum()
    return [float(np.clip(g.mean(), -1, 3)), float(min(top[-1], 12)), float(top.mean()), float((g >= 3).mean()), float(np.log1p(many)), float(np.log1p(len(g)))]


def distinct(docs: list[bytes]) -> list[bytes]:
    """Documents without most near copies: one for each smallest hash of four words in a row."""
    seen: dict[int, bytes] = {}
    for t in docs:
        w = words(t)
        seen.setdefault(min((zlib.crc32(b" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))), default=0), t)
    return list(seen.values())


def pieces(text: bytes) -> set[bytes]:
    return {w[i : i + GRAM] for w in set(words(text)) for i in range(len(w) - GRAM + 1)}


def windows(text: bytes) -> list[bytes]:
    w = words(text)
    return [b" ".join(w[i : i + WINDOW]) for i in range(0, len(w), WINDOW)]


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of samples by the trainer; samples that are too few for it are the dictionary themselves."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b" ".join(dict.fromkeys(samples))[:size]


def fit(toxic: list[bytes], ordinary: list[bytes], prior: float, most: int = 60_000) -> Model | None:
    """Dictionaries from two thirds of the samples, thresholds from the last third; prior: share of toxic labels;
    most: ordinary windows that the trainer gets."""
    toxic, ordinary = distinct(toxic), distinct(ordinary)
    if len(toxic) < 3 or len(ordinary) < 3:
        return None
    cut_t, cut_o = max(1, 2 * len(toxic) // 3), max(1, 2 * len(ordinary) // 3)
    seen_t: Counter = Counter(p for t in toxic[:cut_t] for p in pieces(t))
    seen_t = Counter({p: n for p, n in seen_t.items() if n >= max(3, 0.01 * cut_t)})
    seen_o: Counter = Counter(p for t in ordinary[:cut_o] for p in pieces(t) if p in seen_t)
    own = {p for p, n in seen_t.items() if n / cut_t > 20 * (seen_o[p] + 0.25) / cut_o}
    used = [b" %s " % w for t in toxic[:cut_t] for w in words(t) if any(w[i : i + GRAM] in own for i in range(len(w) - GRAM + 1))]
    plain = sorted(w for t in ordinary[:cut_o] for w in windows(t))
    plain = [plain[k] for k in np.random.default_rng(9).permutation(len(plain))[:most]]
    model = Model(trained(used, TOXIC), trained(plain, ORDINARY), [], [], [])
    c = model.compressors()
    x = np.array([features(gains(t, c)) for t in [*toxic[cut_t:], *ordinary[cut_o:]]])
    y = np.repeat([1.0, 0.0], [len(toxic) - cut_t, len(ordinary) - cut_o])
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.mean, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-6).tolist()
    x = np.hstack([np.ones((len(x), 1)), (x - model.mean) / model.scale])
    b, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = b.tolist()
    return model


MODEL = pa.schema([("model", pa.binary())])
SCORED = pa.schema([("id", pa.int64()), ("score", pa.float64())])


def scorer(model: Model | None, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.compressors() if model else []
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                if model is None:
                    yield batch(SCORED, [b.column(0), np.full(b.num_rows, prior)])
                else:
                    x = np.array([features(gains(t or b"", c)) for t in texts(b.column(1))])
                    yield batch(SCORED, [b.column(0), model.score(x)])

    return run


def fitter(prior: float):
    """(toxic, text) of all samples, in one task -> the pickled model, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples: dict[int, list[bytes]] = {1: [], 0: []}
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                samples[toxic].append(text)
        yield batch(MODEL, [[pickle.dumps(fit(samples[1], samples[0], prior))]])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model | None, float]:
    """Fit on a bounded sample: `sample` documents of each label, by a hash of their ids, `most` characters of each.

    labels has id_col and toxic; nulls there are ignored. One task holds at most 2 * sample * most characters and fits;
    the driver gets the model alone.
    """
    marks = labels.where(f"{id_col} is not null and toxic is not null").groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.substring(F.col(text_col).cast("string"), 1, most).alias("text")).where("text is not null")
    counts = {r["toxic"]: r["count"] for r in marks.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    found = []
    for want in (1, 0):
        picked = marks.where((F.col("toxic") > 0).cast("int") == want).orderBy(F.xxhash64("id"), "id").limit(sample).select("id")
        # `sample` ids at most, whatever the corpus
        mine = src.join(F.broadcast(picked), "id", "left_semi").select(F.lit(want).alias("toxic"), F.xxhash64("id").alias("h"), "text")
        found.append(mine.orderBy("h", "text").limit(sample))
    both = union(found).coalesce(1).sortWithinPartitions(F.desc("toxic"), "h", "text").select("toxic", "text")
    fitted = both.mapInArrow(tidy(fitter(prior)), "model binary").first()
    release_driver(docs.sparkSession)
    return (pickle.loads(fitted[0]) if fitted else None), prior


def score(docs: DataFrame, trained: tuple[Model | None, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row. Null and empty texts have no windows and score as such texts do; without
    labels of both kinds every row scores the share of toxic labels (0 without labels). Rows are scored one by one."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(tidy(scorer(*trained)), "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(col) -> F.col:
    """Rows kept from training: crc32 of the id as text divides by 5. False for a null id."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_clean(docs: DataFrame, trained: tuple[Model | None, float], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic. Null and empty texts score as texts without windows
    do; without labels of both kinds all rows stay, or go where at least half of the labels are toxic."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, prior = trained
        c = model.compressors() if model else []
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                if model:
                    b = b.filter(pa.array(model.score(np.array([features(gains(t or b"", c)) for t in texts(b.column(at))])) < 0.5))
                elif prior >= 0.5:
                    b = b.slice(0, 0)
                yield b

    return docs.mapInArrow(tidy(run), docs.schema)
