"""Near-duplicates at the pipeline's limit, against brute force."""

import itertools
import random

from tests.llm import brute

DOCS = "doc_id long, text string"


def kept(rows, over):
    """Ids that stay when documents with 100 * intersection >= over * union are linked."""
    s = {i: brute.shingles(t) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(s, 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= over * len(s[a] | s[b])]
    r = brute.roots(s, edges)
    return {i for i in s if r[i] == i}


def test_pipeline_drops_copies_from_0_8(spark):
    import corpus_pipeline

    rng = random.Random(21)
    rows = []
    for i in range(30):
        w = brute.sentence(rng, 104).split()
        rows.append((2 * i, " ".join(w)))
        for k in ((20, 70), (20, 50, 80))[i % 3 == 0]:  # Jaccard 90 / 110, or 85 / 115 for every third
            w[k] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert len(kept(rows, 85)) == 60 and len(kept(rows, 80)) == 40
    assert got == kept(rows, 80)


def form_letters(n, slots, values, seed=5):
    """Documents of one form whose slots have few values each: all share most shingles, few are linked."""
    rng = random.Random(seed)
    form = brute.sentence(rng, 120).split()
    rows = set()
    while len(rows) < n:
        rows.add(tuple(rng.randrange(values) for _ in range(slots)))
    out = []
    for i, held in enumerate(sorted(rows, key=lambda _: rng.random())):
        w = list(form)
        for k, v in enumerate(held):
            w[10 + 25 * k] = f"slot{k}value{v}"
        out.append((i, " ".join(w)))
    return out


def test_links_in_a_crowd_of_unlinked_documents(spark):
    from spindle.llm.minhash import near_duplicates

    rows = form_letters(1500, 3, 60)
    want = brute.near(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: want[i][1] for i in want}


def test_one_dense_group_is_one_component(spark):
    """Variants of one text, mean Jaccard about 0.82: few neighbours in the sorted orders are linked, but all hang together."""
    from spindle.llm.minhash import near_duplicates

    rng = random.Random(7)
    base, rows = brute.sentence(rng, 400).split(), []
    for i in range(700):
        w = list(base)
        for k in rng.sample(range(400), 4):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    want = brute.near(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: want[i][1] for i in want}


def test_bounds_of_the_exact_pass(spark):
    """Sets of many sizes, blocks of a few rows: every pair that reaches the limit is among the candidates."""
    from pyspark.sql import functions as F

    from spindle.llm import minhash
    from spindle.llm.common import Scratch

    rng = random.Random(9)
    rows = []
    for g in range(6):
        w = brute.sentence(rng, (8, 40, 120, 300, 900, 2500)[g]).split()
        for _ in range(25):
            v = w[: len(w) - rng.randrange(1 + len(w) // 6)]
            for _ in range(rng.randrange(1 + len(w) // 60)):
                v[rng.randrange(len(v))] = f"w{rng.randrange(5)}"
            rows.append((len(rows), " ".join(v)))
    docs = spark.createDataFrame(rows, "id long, text string")
    s = {i: brute.shingles(t) for i, t in rows}
    block, minhash.BLOCK = minhash.BLOCK, 7
    try:
        for over in (80, 85):
            found = {(r["a"], r["b"]) for r in minhash.settle(Scratch(spark), docs.select("id", F.col("id").alias("comp")), docs, 5, over).collect()}
            want = {(a, b) for a, b in itertools.combinations(s, 2) if 100 * len(s[a] & s[b]) >= over * len(s[a] | s[b])}
            assert len(want) > 300 and want <= found
    finally:
        minhash.BLOCK = block


def test_short_orders_go_to_few_files(spark):
    """The sorted orders are cut by their size: few files for few rows, and no pair is lost however they are cut."""
    import os

    from spindle.llm import minhash as m
    from spindle.llm.common import Scratch

    rng = random.Random(41)
    rows = [(bytes([0]) + bytes([0, 0, 0, rng.randrange(40)]) * 4 + bytes(rng.randrange(256) for _ in range(16)), k, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "k binary, id long, comp long")
    ordered = sorted(rows)
    want = {tuple(sorted((x[1], y[1]))) for o in (1, 2, 3) for x, y in zip(ordered, ordered[o:]) if x[0][:17] == y[0][:17]}
    key, files = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    try:
        for parts in (1, 64):
            spark.conf.set(key, parts)
            scratch = Scratch(spark)
            assert want <= {tuple(r) for r in m.candidates(scratch, df, 3, 4).collect()}
            files.append(sum(f.startswith("part-") for f in os.listdir(f"{scratch.root.removeprefix('file:')}/1")))
    finally:
        spark.conf.set(key, before)
    assert files[1] < 64


def test_scratch_tables_start_few_processes(spark, monkeypatch):
    """Of a scratch table only its files are made, nothing beside them, and few rows in many tasks go to few files."""
    import os

    from spindle.llm.common import FILES, Scratch, components

    scratch = Scratch(spark)
    folder = scratch.root.removeprefix("file:")
    rows = spark.range(0, 3000, 1, 7).selectExpr("id", "repeat('x', cast(id % 9 as int)) x")
    assert sorted(map(tuple, scratch.keep(rows).collect())) == [(k, "x" * (k % 9)) for k in range(3000)]
    assert len(os.listdir(f"{folder}/1")) == 7 and all(f.startswith("part-") for f in os.listdir(f"{folder}/1"))

    files = {}
    keep = Scratch.keep

    def seen(self, df, *a):
        out = keep(self, df, *a)
        files[self.count] = len(os.listdir(out._spindle_path.removeprefix("file:")))
        return out

    monkeypatch.setattr(Scratch, "keep", seen)
    key, joined = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key), spark.conf.get(joined)
    rng = random.Random(43)
    edges = [(5 * rng.randrange(400) + k % 5, 5 * rng.randrange(400) + k % 5) for k in range(1500)]
    try:
        spark.conf.set(key, 32)
        spark.conf.set(joined, "false")
        found = dict(map(tuple, components(scratch, spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()))
    finally:
        spark.conf.set(key, before[0])
        spark.conf.set(joined, before[1])
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    assert found == want and len(files) > 4 and max(files.values()) <= FILES
