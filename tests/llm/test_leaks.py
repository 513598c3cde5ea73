"""Paraphrases that only the latent space finds, large corpora, long texts and odd tables."""

import itertools
import random

import numpy as np

from tests.llm import brute

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def topics(rng, n=25, size=8):
    """Topics of word pairs that stand for each other, and documents in which either word of a pair is used."""
    pairs = [[(f"ta{t}x{k}", f"tb{t}x{k}") for k in range(size)] for t in range(n)]
    common = [f"c{k}" for k in range(40)]

    def passage(t, pick):
        w = []
        for p in pairs[t]:
            w += [rng.choice(common), pick(p), rng.choice(common)]
        return w

    docs = [" ".join(itertools.chain.from_iterable(passage(t, rng.choice) for _ in range(4))) for t in range(n) for _ in range(12)]
    return pairs, common, docs


def test_synonyms_are_found_through_the_latent_space(spark):
    from spindle.llm import decontamination as d

    rng = random.Random(31)
    pairs, common, docs = topics(rng)
    items, rows, want = [], [(1000 + k, t) for k, t in enumerate(docs)], {}
    for t in range(0, 25, 2):
        w = []
        for a, _ in pairs[t]:
            w += [rng.choice(common), a, rng.choice(common)]
        items.append((t, " ".join(w)))
        other = dict(pairs[t][:6])  # all heavy words but the answer's are replaced by their fellows
        rows.append((t, brute.sentence(rng, 40) + " " + " ".join(other.get(x, x) for x in w) + " " + brute.sentence(rng, 40)))
        want[t] = [t]
    # with the words' weights in this corpus, words alone give a cosine below the limit
    n, df = len(rows), {}
    for _, text in rows:
        for x in set(text.split()):
            df[x] = df.get(x, 0) + 1
    for t in want:
        item = dict(items)[t].split()
        para = dict(rows)[t].split()[40 : 40 + len(item)]
        idf = {x: np.log((n + 1) / (df.get(x, 0) + 1)) + 1 for x in item + para}
        u, v = ({x: w.count(x) * idf[x] for x in w} for w in (item, para))
        plain = sum(u[x] * v.get(x, 0) for x in u) / np.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
        assert plain < d.COSINE
    rank = d.RANK
    assert rank >= 64
    d.RANK = 30
    try:
        out = d.decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    finally:
        d.RANK = rank
    assert {r["doc_id"]: r["item_ids"] for r in out if r["doc_id"] in want and r["contaminated"]} == want


def test_against_all_pairs_of_documents_and_items(spark):
    """Leaks by the longest common subsequence alone, over all pairs, are the leaks that the search gives."""
    from spindle.llm.decontamination import ANSWER, SHARE, VERBATIM, decontaminate

    rng = random.Random(32)
    items = [(i, brute.sentence(rng, rng.randint(14, 90))) for i in range(25)]
    rows = []
    for k in range(50):
        parts = [brute.sentence(rng, rng.randint(20, 120))]
        if k % 3 == 0:
            w = rng.choice(items)[1].split()
            for j in rng.sample(range(len(w)), len(w) // rng.choice((4, 8, 50))):
                w[j] = brute.sentence(rng, 1)
            parts += [" ".join(w), brute.sentence(rng, 30)]
        rows.append((k, " ".join(parts)))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b):
                old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    want = {}
    for i, text in rows:
        w, found = text.split(), []
        for item, t in items:
            x = t.split()
            best = max((lcs(x, w[a : a + 3 * len(x)]), lcs(x[-max(1, len(x) // 4) :], w[a : a + 3 * len(x)])) for a in range(0, len(w), max(1, len(x) // 2)))
            if best[0] >= VERBATIM * len(x) or (best[0] >= SHARE * len(x) and best[1] >= ANSWER * max(1, len(x) // 4)):
                found.append(item)
        if found:
            want[i] = found
    out = decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert want and {r["doc_id"]: r["item_ids"] for r in out if r["contaminated"]} == want


def test_the_screen_does_not_close_as_the_corpus_grows():
    """Weights of a corpus a million times as large: windows with a third of an item's words replaced still pass."""
    from spindle.llm import decontamination as d

    rng = np.random.default_rng(33)
    for n in (1e4, 1e6, 1e9):
        passed = 0
        for _ in range(300):
            df = rng.pareto(0.7, 32) + 1
            weight = (np.log((n + 1) / (np.minimum(df * n / 1e4, n) + 1)) + 1) ** 2
            gone = rng.random(32) < 0.35
            passed += weight[~gone].sum() >= d.ABLE * weight.sum()
        assert passed >= 297


def test_long_texts_blocks_and_odd_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from spindle.llm import decontamination as d

    monkeypatch.setattr(d, "BLOCK", 3)
    rng = random.Random(34)
    items = [(i, brute.sentence(rng, 30)) for i in range(8)] + [(8, None), (None, "x y z"), (3, "another text of the item with words enough to be looked for")]
    long = brute.sentence(rng, 150_000).split()
    long[140_000:140_030] = items[5][1].split()
    rows = [(1, " ".join(long)), (2, items[0][1]), (2, items[0][1]), (2, "an id again"), (None, items[1][1]), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("id", "item", "share", "items", "n", "lang"):
        df = df.withColumn(name, F.lit("x"))
    bench = spark.createDataFrame(items, ITEMS).withColumn("id", F.lit(1)).withColumn("answer", F.lit("no"))
    out = sorted(((r["doc_id"], r["item_ids"]) for r in d.decontaminate(df, bench).collect()), key=str)
    assert out == sorted([(1, [5]), (2, [0]), (2, [0]), (2, [0]), (None, []), (4, []), (5, [])], key=str)


def test_the_space_is_fitted_on_all_documents(spark):
    """Passages of every document are in the fit, however many documents there are and wherever they stand."""
    from spindle.llm import decontamination as d

    rng = random.Random(35)
    item = brute.sentence(rng, 32).split()
    rows = [(k, brute.sentence(rng, 20)) for k in range(4000)] + [(4000 + k, " ".join(item[:24] + [f"only{k}x{j}" for j in range(8)])) for k in range(3000)]
    src = spark.createDataFrame(rows, DOCS).withColumnRenamed("doc_id", "id")
    vocabulary = {x: k for k, x in enumerate(dict.fromkeys(x.encode() for x in item))}
    idf = np.ones(d.COUNTERS, np.float32)
    # each of the 3,000 documents has a passage of its own; the sample had 3,000 of 7,000 documents and 2,000 passages
    assert d.related(spark, src, vocabulary, idf).count() >= 2990


def test_the_pipeline_fits_the_space_on_all_documents(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from spindle.llm import decontamination as d

    rng = random.Random(36)
    item = brute.sentence(rng, 32).split()
    rows = [(k, " ".join(rng.sample(item, 20))) for k in range(2500)]
    spark.createDataFrame([(1, " ".join(item))], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    fitted, basis = [], d.randomised_basis

    def counted(*args, more=None, **names):
        fitted.append(more.count() if more is not None else 0)
        return basis(*args, more=more, **names)

    monkeypatch.setattr(d, "randomised_basis", counted)
    corpus_pipeline.drop_leaks(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).count()
    assert fitted[0] >= 2490


def test_what_is_searched_is_fitted(spark):
    """Passages in which the items' words carry enough only off a fixed grid of 32 words are in the fit as well."""
    from spindle.llm import decontamination as d

    rng = random.Random(37)
    item = [f"item{j}" for j in range(32)]
    rows = [(k, " ".join([*brute.sentence(rng, 16).split(), *item[:12], *(f"only{k}x{j}" for j in range(8)), *item[12:24], *brute.sentence(rng, 16).split()])) for k in range(300)]
    src = spark.createDataFrame(rows, DOCS).withColumnRenamed("doc_id", "id")
    vocabulary = {x.encode(): k for k, x in enumerate(item)}
    fit = d.related(spark, src, vocabulary, np.ones(d.COUNTERS, np.float32)).collect()
    met = {i for r in fit for i in np.frombuffer(r["i"], np.int32).tolist()}
    assert {int(x) for x in d.slots(np.array([32 + d.counter(f"only{k}x{j}".encode()) for k in range(300) for j in range(8)]), 32)} <= met


def test_words_are_hashed_together():
    """Hashes of all words at once are those of each alone, whatever the pieces; codes and counts follow them."""
    from spindle.llm import decontamination as d

    rng = random.Random(38)
    texts = ["", "  One, two;ONE\ttwo\n", "ÀÉ ß Σ ΟΔΟΣ", "x" * 300_000 + " y", None, brute.sentence(rng, 60_000), "(z)"]
    h, begin = d.hashes(texts)
    w = [d.words(t) for t in texts]
    assert np.diff(begin).tolist() == [len(x) for x in w]
    alone = {x: int(d.hashed(x)[0][0]) for x in set(itertools.chain.from_iterable(w))}
    assert h.tolist() == [alone[x] for x in itertools.chain.from_iterable(w)] and len(set(alone.values())) == len(alone)
    vocabulary = {x: k for k, x in enumerate(w[5][:50:7] + [b"x" * 300_000])}
    at, _ = d.Codes(vocabulary).of(texts)
    assert at.tolist() == [vocabulary.get(x, len(vocabulary) + d.counter(x)) for x in itertools.chain.from_iterable(w)]


def test_counts_of_documents_are_never_too_few(spark):
    from spindle.llm import decontamination as d

    rows = [(k, f"a b a c{k % 7} d{k}" + " a" * (k % 3)) for k in range(500)] + [(500, "")]
    counts, n = d.frequencies(spark.createDataFrame(rows, DOCS))
    assert n == 501 and counts[d.counter(b"a")] == counts[d.counter(b"b")] == 500
    assert all(counts[d.counter(b"d%d" % k)] >= 1 for k in range(500)) and counts.sum() <= 500 * 4


def test_the_driver_fetches_in_few_jobs(spark):
    """Where no parts of a shuffle are joined, the driver still starts no job for each part of it."""
    from spindle.llm import decontamination as d

    rng = random.Random(39)
    items = [(k, brute.sentence(rng, 30)) for k in range(60)]
    rows = [(k, items[k][1] if k < 5 else brute.sentence(rng, 40)) for k in range(40)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        began = jobs()
        out = d.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["id"], r["item"]) for r in out) == [(k, k) for k in range(5)]
    assert jobs() - began < 64  # 64 parts were fetched one by one: for the items, and in each of three rounds


def test_leading_columns_in_place():
    from spindle.llm import decontamination as d

    x = np.random.default_rng(40).standard_normal((1000, 12)).astype(np.float32)
    for rank, step in ((12, 100), (7, 64), (1, 4096)):
        y = x.copy()
        got = d.leading(y, rank, step)
        assert (got == x[:, :rank]).all() and got.flags.c_contiguous and np.shares_memory(got, y)
