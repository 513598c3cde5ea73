"""Vectors, pages, WARC records, toxicity, components and the pipeline."""

import random

import numpy as np
import pytest

from tests.llm import brute

pytest.importorskip("public_tokenizers")


def test_near_vectors(spark):
    from spindle.llm.embeddings import near_vectors

    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    x = np.vstack([base, base[:20] + 0.12 * rng.standard_normal((20, 16)), base[:5], 3 * base[5:10], base[:3] + 0.3 * rng.standard_normal((3, 16))]).astype(np.float32)
    rows = [(2 * i, v.tolist(), i) for i, v in enumerate(x)] + [(901, None, 0), (903, [0.0] * 16, 0), (905, [float("nan")] * 16, 0), (907, [], 0), (909, [1.0, None], 0), (911, [1.0, 2.0], 0), (913, [1.0, 2.0], 0), (None, x[0].tolist(), 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    edges = [(2 * int(a), 2 * int(b)) for a, b in np.argwhere(near)]
    want = brute.roots([2 * i for i in range(len(x))], edges)
    expected = {2 * i: (int(near[i].sum()), want[2 * i], want[2 * i] == 2 * i) for i in range(len(x))}
    expected |= {i: (0, i, True) for i in (901, 903, 905, 907, 909)} | {911: (1, 911, True), 913: (1, 911, False), None: (0, None, True)}
    assert got == expected
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_pieces_of_a_full_filter_count_each_pair_once(spark, monkeypatch):
    from spindle.llm import embeddings

    monkeypatch.setattr(embeddings, "PIECE", 7)
    rng = np.random.default_rng(5)
    x = (np.ones(8) + 0.02 * rng.standard_normal((60, 8))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {i: (59, 0) for i in range(60)}


def test_list_decoding_is_exhaustive():
    from spindle.llm.embeddings import code, decode, unit

    rotation, words, least = code(24, 500, 0.9)
    x = rotation @ unit(np.random.default_rng(1).standard_normal(24))
    parts, at = [], 0
    for w in words:
        parts.append(w @ x[at : at + w.shape[1]])
        at += w.shape[1]
    total = parts[0]
    for p in parts[1:]:
        total = (total[:, None] + p[None, :]).ravel()
    assert decode(x, words, least).tolist() == np.flatnonzero(total >= least).tolist()


def test_components_of_chains_and_stars(spark):
    from spindle.llm.common import Scratch, components

    rng = random.Random(1)
    chain = list(range(100, 300))
    shuffled = rng.sample(range(1000, 1200), 200)
    edges = list(zip(chain, chain[1:], strict=False)) + list(zip(shuffled, shuffled[1:], strict=False)) + [(5000, 5000 + i) for i in range(1, 50)] + [(7, 7), (8, 9), (9, 8)]
    got = {r["node"]: r["comp"] for r in components(Scratch(spark), spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    nodes = {x for e in edges for x in e}
    want = brute.roots(nodes, edges)
    assert {n: got.get(n, n) for n in nodes} == want


def test_the_drivers_jvm_gives_freed_memory_back(spark):
    """What is freed between blocks in use stays with the C library; a table that is kept gives it back to the system."""
    from spindle.llm.common import Scratch

    jvm, size = spark.sparkContext._jvm, 60_000
    native, pid = jvm.org.apache.spark.unsafe.Platform, jvm.java.lang.ProcessHandle.current().pid()

    def held() -> float:
        with open(f"/proc/{pid}/status") as lines:
            return next(int(x.split()[1]) for x in lines if x.startswith("VmRSS")) / 1024

    scratch, few = Scratch(spark), spark.range(10)
    for _ in range(3):
        assert scratch.keep(few).count() == 10  # code is loaded
    blocks = [native.allocateMemory(size) for _ in range(4000)]
    for x in blocks[1:]:
        native.copyMemory(None, blocks[0], None, x, size)
    kept = blocks[::40]
    for x in sorted({*blocks} - {*kept}):
        native.freeMemory(x)
    before = held()
    scratch.keep(few)
    after = held()
    for x in kept:
        native.freeMemory(x)
    assert before - after > 60  # of 220 MB


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a = "</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav>
<div class="ad">Buy</div><article><h1>Head</h1><p>One&nbsp;two <b>bold</b>text<br>next<p>Second &lt;p&gt;<div id="comments"><p>reader</p></div></article>
<aside>side</aside><footer>foot</footer></body></html>"""


def test_page_lines():
    from spindle.llm.extraction import common, lines, main_text

    assert main_text(lines(PAGE), None) == "Head\nOne two boldtext next\nSecond <p>"
    assert main_text(lines(PAGE), lines(PAGE)) == "Head\nOne two boldtext next\nSecond <p>"
    a, b = [lines(f"<div>Site</div><div>Body {k}</div><div>Terms</div>") for k in "ab"]
    assert main_text(a, b) == "Body a"
    rng = random.Random(2)
    for _ in range(50):
        x, y = [rng.choice("abc") for _ in range(12)], [rng.choice("abc") for _ in range(10)]
        size = [[0] * 11 for _ in range(13)]
        for i in range(12):
            for j in range(10):
                size[i + 1][j + 1] = size[i][j] + 1 if x[i] == y[j] else max(size[i][j + 1], size[i + 1][j])
        found = [x[k] for k in sorted(common(x, y))]
        rest = iter(y)
        assert len(found) == size[12][10] and all(c in rest for c in found)


def test_extract(spark):
    from spindle.llm.extraction import extract

    rows = [(1, "http://h.example/a/1", PAGE), (2, "http://h.example/a/2", PAGE), (3, "http://h.example/b", None), (4, None, "<p>alone"), (5, "http://[", ""), (6, "http://g.example/", "<p>" + "x " * 50_000 + "<p>y"), (6, "http://g.example/", "<p>" + "x " * 50_000 + "<p>y")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    text = "Head\nOne two boldtext next\nSecond <p>"
    assert got[:5] == [(1, text, len(text)), (2, text, len(text)), (3, "", 0), (4, "alone", 5), (5, "", 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_warc_round_trip(spark):
    import gzip

    from spindle.llm import warc

    pages = spark.createDataFrame([(1, "http://h/a", PAGE), (2, None, None), (1, "http://h/a", PAGE)], "page_id long, url string, html string")
    out = warc.derivatives(warc.responses(pages)).collect()
    assert [r["kind"] for r in out].count("metadata") == [r["kind"] for r in out].count("conversion") == 3
    for r in out:
        (headers, block), = warc.read(bytes(r["record"]))
        assert warc.get(headers, "WARC-Refers-To") == r["refers_to"] and warc.get(headers, "WARC-Record-ID") == r["record_id"]
        assert warc.get(headers, "WARC-Block-Digest") == warc.digest(block) == r["payload_digest"]
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nX-A: 1\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n"
    response = warc.write([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "u"), ("WARC-Payload-Digest", "sha1:P")], chunked)
    image = warc.write([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:y>")], b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x00")
    other = warc.write([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:z>")], b"GET /")
    data = gzip.compress(response) + gzip.compress(image + other)
    rows = spark.createDataFrame([(7, data), (8, None), (9, b"broken"), (10, response[:-20])], "key long, record binary")
    out = {(r["refers_to"], r["kind"]): r for r in warc.derivatives(rows).collect()}
    assert set(out) == {("<urn:x>", "metadata"), ("<urn:x>", "conversion"), ("<urn:y>", "metadata")}
    assert out["<urn:x>", "conversion"]["text"] == "abcde" and out["<urn:x>", "conversion"]["source_payload_digest"] == "sha1:P"
    assert b"http-header-x-a: 1" in bytes(out["<urn:x>", "metadata"]["record"])


def toxic_corpus(n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        w = brute.sentence(rng, 80).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(["scoundrel", "blockhead", "nincompoop"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    from pyspark.sql import functions as F

    from spindle.llm import toxicity

    rows, labels = toxic_corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trained = toxicity.train(docs, marks.where(~toxicity.held_out(F.col("doc_id"))))
    more = spark.createDataFrame([(9001, None), (9002, ""), (9003, "scoundrel"), (None, "al bo"), (9004, "al bo " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs.unionByName(more), trained).collect()}
    right = sum(got[i]["predicted"] == toxic for i, _, toxic in labels)
    assert right >= 0.97 * len(labels)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[9001]["score"] == got[9002]["score"] < 0.5
    nothing = toxicity.train(docs, marks.where("false"))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}
    kept = toxicity.keep_clean(docs, trained)
    assert kept.columns == docs.columns and kept.count() == sum(1 - got[i]["predicted"] for i, _ in rows)


def test_toxicity_is_fitted_by_a_task(spark, monkeypatch):
    """The driver, whose memory every stage of a session shares, neither holds the sample nor fits."""
    import os

    from pyspark.sql import functions as F

    from spindle.llm import toxicity

    rows, labels = toxic_corpus(60)
    driver, real = os.getpid(), toxicity.fit

    def elsewhere(*args):
        assert os.getpid() != driver
        return real(*args)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, prior = toxicity.train(docs, marks)
    held = dict(rows)
    order = {i: h for i, h in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    found = [[held[i].encode() for i, _, t in sorted(labels, key=lambda x: order[x[0]]) if t == want] for want in (1, 0)]
    assert model == real(*found, prior) and 0 < prior < 1
    assert toxicity.train(docs.where("false"), marks)[0] is None


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, labels = toxic_corpus(160)
    rows += [(1000 + i, t) for i, t in brute.corpus()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leaked = " ".join(rows[1][1].split()[20:50])
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = dict(rows)
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "minhash_dedup":
            want = brute.near(list(held.items()), 80)
            assert set(got) == {i for i in held if want[i][2]}
        elif name == "suffix_dedup":
            want = brute.repeats(list(held.items()), 50, False)
            assert set(got) == set(held)
            assert all(len((got[i] or "").encode()) <= want[i][0] - want[i][1] for i in got)
            assert all(got[i] == held[i] for i in got if not want[i][1])
        elif name == "decontamination":
            assert set(held) - set(got) == {1}
        held = got
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in whole} == set(held)
    assert sum(r["length"] for r in whole if r["doc_id"] == 2) == next(r["doc_tokens"] for r in whole if r["doc_id"] == 2)
