"""Near-duplicates, repeated passages, token counts, packing and leaks against brute force."""

import random
import zlib

import pytest

from tests.llm import brute

tokens = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    from pyspark.sql import functions as F

    # clashing names: the operators must not care
    return spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("id"), F.lit("x").alias("n"), F.lit(None).cast("string").alias("lang"))


def test_near_duplicates(docs, rows):
    from spindle.llm.minhash import near_duplicates

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == brute.near(rows)


def test_near_duplicates_of_a_large_group(spark):
    from spindle.llm.minhash import near_duplicates

    rng = random.Random(3)
    base = brute.sentence(rng, 200).split()
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute.near(rows)
    assert got == {i: want[i][1] for i in want}


def test_null_ids_and_repeated_rows(spark):
    from spindle.llm.minhash import near_duplicates
    from spindle.llm.repeats import dedup_bytes, dedup_words

    t = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21"
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (2, t), (9, None)], DOCS)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(2, 2, True), (5, 2, False), (5, 2, False), (9, 9, True), (None, None, True)], key=str)
    for f in (dedup_words, dedup_bytes):
        got = sorted(((r["doc_id"], r["n_removed"] > 0) for r in f(df).collect()), key=str)
        assert got == sorted([(2, False), (5, True), (5, True), (9, False), (None, False)], key=str)


@pytest.mark.parametrize("chunk", [2000, 2])
def test_repeated_words(docs, rows, chunk, monkeypatch):
    """Also with indexes so small that names are refined."""
    from spindle.llm import repeats

    monkeypatch.setitem(repeats.CHUNK, False, chunk)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.dedup_words(docs).collect()}
    assert got == brute.repeats(rows, 20, True)


@pytest.mark.parametrize(("name", "chunk"), [("by_run_length", 8000), ("by_run_length", 2), ("by_automaton", 100)])
def test_repeated_bytes(docs, rows, name, chunk, monkeypatch):
    from spindle.llm import repeats

    monkeypatch.setitem(repeats.CHUNK, True, chunk)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in repeats.dedup_bytes(docs, index=getattr(repeats, name)).collect()}
    assert got == brute.repeats(rows, 50, False)


def test_segments(rows, monkeypatch):
    """A text that doesn't fit a segment is cut into runs that hold each window once, whatever the names."""
    from spindle.llm import repeats

    monkeypatch.setattr(repeats, "SEGMENT", 64)
    parts = [r for r in rows if r[1]]
    for names in (repeats.PIECES, repeats.OTHER, repeats.WHOLE):
        made = repeats.run_maker(repeats.BYTES, names)(iter([repeats.pa.record_batch([[r[0] for r in parts], [0] * len(parts), [r[1] for r in parts], [0] * len(parts)], names=["id", "h", "text", "start"])]))
        covered = {}
        for b in made:
            for i, v in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                covered.setdefault(i, []).extend(range(v >> repeats.SHIFT, (v >> repeats.SHIFT) + (v & repeats.WINDOWS)))
        for i, t in parts:
            assert sorted(covered.get(i, [])) == list(range(max(0, len(t.encode()) - 49)))


def test_indexes_against_a_plain_search():
    """Regions of few letters, of several documents and versions: both indexes give what a search of all windows gives."""
    import numpy as np

    from spindle.llm import repeats

    rng = random.Random(12)
    for seed in range(12):
        kind = repeats.Kind(6, 3, True)
        n = rng.randint(2, 40)
        base = "".join(rng.choice("abc"[: 1 + seed % 3]) for _ in range(60))
        regions = []
        for _ in range(n):
            at = rng.randrange(50)
            x = base[at : at + rng.randint(6, 30)].ljust(6, "z")
            regions.append((x if rng.random() < 0.6 else x + "".join(rng.choice("abcd") for _ in range(9))).encode())
        ids = np.array(sorted(rng.randrange(8) for _ in range(n)), np.int64)
        names, hs = np.zeros(n, np.int64), np.array([rng.randrange(2) for _ in range(n)], np.int64)
        want = [[any(ids[j] < ids[k] and x[s : s + 6] in regions[j] for j in range(n)) for s in range(len(x) - 5)] for k, x in enumerate(regions)]
        for index in (repeats.by_run_length, repeats.by_automaton):
            assert index(names, regions, ids, hs, kind).tolist() == sum(want, [])
        kind = repeats.Kind(3, 2, False)
        words = [b" ".join(bytes([c]) for c in x) for x in regions]
        order = sorted(range(n), key=lambda k: (ids[k], hs[k]))
        words, ids, hs = [words[k] for k in order], ids[order], hs[order]
        grams = [[tuple(x.split()[s : s + 3]) for s in range(len(x.split()) - 2)] for x in words]
        want = [[any(g in grams[j] and (ids[j] < ids[k] or (ids[j] == ids[k] and hs[j] == hs[k] and j < k)) for j in range(n)) or g in grams[k][:s] for s, g in enumerate(grams[k])] for k in range(n)]
        assert repeats.by_automaton(names, words, ids, hs, kind).tolist() == sum(want, [])


def test_texts_that_share_an_id(spark):
    """They are documents of their own: neither loses what only the other has, nor counts as earlier."""
    from spindle.llm import repeats

    rng = random.Random(13)
    t, u = brute.sentence(rng, 60), brute.sentence(rng, 60)
    df = spark.createDataFrame([(1, t), (5, t + " and some more"), (5, u), (5, u + " end"), (7, u)], DOCS)
    for f, n in ((repeats.dedup_bytes, len(t.encode())), (repeats.dedup_words, 60)):
        got = sorted((r["doc_id"], r["n_removed"]) for r in f(df).collect())
        assert got == [(1, 0), (5, 0), (5, 0), (5, n), (7, n if f is repeats.dedup_words else len(u.encode()))]
    assert sorted(r["text"] for r in repeats.strip_bytes(df).collect()) == sorted([t, " and some more", u, u + " end", ""])


def test_token_counts(docs, rows):
    from spindle.llm.tokens import load, token_counts

    path = tokens.path("byte_bpe_50k.json")
    lib = load(path)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, path).collect()}
    want = {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    assert got == {i: (*x, x[1] > 512) for i, x in want.items()}


def test_token_counts_of_rare_pieces_and_repeated_rows(spark, rows, monkeypatch):
    """All pieces but a few are dealt; odd characters, repeated rows, null ids and clashing names."""
    from pyspark.sql import functions as F

    from spindle.llm import tokens as operator

    monkeypatch.setattr(operator, "HEAD", 10)
    path = tokens.path("byte_bpe_50k.json")
    lib = operator.load(path)
    more = [*rows, *rows[:9], (None, "it\u2019s \u65e5\u672c x"), (None, None), (7001, "a <|endoftext|> b"), (7002, "curly \u2019quote\u2019 " * 400)]
    df = spark.createDataFrame(more, DOCS).select("*", F.lit(1).alias("id"), F.lit(1).alias("n"), F.lit("x").alias("piece"), F.lit("x").alias("copies"), F.lit(2).alias("h"))
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in operator.token_counts(df, path).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in more), key=str)


def test_fast_paths_are_the_library():
    from spindle.llm.tokens import Cutter, Ids

    rng = random.Random(5)
    odd = ["", " ", "a  b", " \n x\n\n y ", "it's don't <|endoftext|> x", "naïve ÷ × 12 345", "日本語", "\tx\r\n y", "İs ŒŁ", "a\x1cb c\x85d", "don'T I'LL 'S", "é", "x y"]
    odd += ["".join(rng.choice("ab 1'\n.é,  s\t") for _ in range(60)) for _ in range(200)]
    cutter, ids = Cutter(tokens.path("byte_bpe_50k.json")), Ids(tokens.path("word_bpe_49k.json"))
    assert cutter.known
    for t in odd:
        assert "".join(cutter.pieces(t)) == t
        assert sum(cutter.sizes(cutter.pieces(t))) == len(cutter.tok.encode(t, add_special_tokens=False))
        if (chunks := cutter.chunks(t)) is not None:
            assert [p for c in chunks for p in cutter.pieces(c)] == cutter.pieces(t)
    assert [ids.encode(t) for t in odd] == [ids.whole(t) for t in odd]


def test_ids_of_many_texts(monkeypatch):
    """As the library's, where memories turn over and blocks end anywhere; accented words of plain texts take no call of it."""
    import pyarrow as pa

    from spindle.llm import tokens as operator

    monkeypatch.setattr(operator, "WORDS", 40)
    rng = random.Random(15)
    texts = [None, "", " ", " a ", *(" ".join("".join(rng.choice("abeéÀñß'1.-s") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(30))) for _ in range(300))]
    ids = operator.Ids(tokens.path("word_bpe_49k.json"))
    want = [ids.whole(t or "") for t in texts]
    monkeypatch.setattr(operator.Ids, "whole", None)
    for most in (1, 300, 1 << 22):
        assert list(ids.encode_all(pa.array(texts), most)) == want
        assert list(ids.encode_all(pa.array(texts).slice(7, 90), most)) == want[7:97]
    assert list(ids.encode_all(pa.array([], pa.string()))) == []


def test_packing(docs, rows):
    import numpy as np

    from spindle.llm.packing import pack
    from spindle.llm.tokens import load

    path = tokens.path("word_bpe_49k.json")
    lib = load(path)
    out = pack(docs, path).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        x = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(x))
            assert r["ids_crc32"] == zlib.crc32(x[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(x)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    used = padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
        used += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.05 * used


def test_patterns_cover_demand():
    import numpy as np

    from spindle.llm.packing import patterns

    rng = np.random.default_rng(1)
    demand = rng.integers(0, 4000, 256)
    plan = patterns(demand, 256)
    used = np.zeros(256, int)
    for use, n in plan:
        assert sum(k * u for k, u in use.items()) <= 256
        for k, u in use.items():
            used[k - 1] += u * n
    assert (used <= demand).all() and used.sum() > 0.97 * demand.sum()
    least = (demand * np.arange(1, 257)).sum() / 256
    assert sum(n for _, n in plan) <= 1.01 * least


def test_leaks(spark):
    from spindle.llm.decontamination import decontaminate

    rng = random.Random(8)
    items = [(i, brute.sentence(rng, 18 + i)) for i in range(40)] + [(90, None), (91, ""), (92, "short one")]
    docs = [(i, brute.sentence(rng, 150)) for i in range(60)]
    want = {}
    for i in range(0, 40, 2):
        w = items[i][1].split()
        if i % 4 == 0:  # a paraphrase: some words replaced, not the answer's
            for k in range(0, len(w) * 3 // 4, 6):
                w[k] = "elsewise"
        docs[i] = (i, brute.sentence(rng, 30) + " " + " ".join(w) + " " + brute.sentence(rng, 25))
        want[i] = [i]
    docs += [(100, None), (101, ""), (None, items[0][1])]
    out = decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(out) == len(docs)
    assert {r["doc_id"]: r["item_ids"] for r in out if r["contaminated"]} == want


def test_basis_is_the_singular_space(spark):
    import numpy as np

    from spindle.llm.decontamination import randomised_basis

    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 5)) @ rng.standard_normal((5, 80))
    basis = randomised_basis(spark, [(np.arange(80), r) for r in a], 80, 5)
    assert np.abs(a - a @ basis @ basis.T).max() < 1e-3 * np.abs(a).max()


def test_empty_tables(spark):
    from spindle.llm.decontamination import decontaminate
    from spindle.llm.minhash import near_duplicates
    from spindle.llm.packing import pack
    from spindle.llm.repeats import dedup_bytes, dedup_words
    from spindle.llm.tokens import token_counts

    none = spark.createDataFrame([], DOCS)
    for f in (near_duplicates, dedup_words, dedup_bytes, lambda d: token_counts(d, tokens.path("byte_bpe_50k.json")), lambda d: pack(d, tokens.path("word_bpe_49k.json")), lambda d: decontaminate(d, spark.createDataFrame([], "item_id long, text string"))):
        assert f(none).collect() == []
