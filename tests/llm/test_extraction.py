"""Main text of pages without article markup, against a plain version that holds all pages."""

import random

import pytest

from tests.llm import brute

PAGES = "page_id long, url string, html string"


def lcs(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
    return size[-1][-1]


def site(seed=3, hosts=3, pages=12):
    """Pages without article markup: a template of each host around lines of their own."""
    rng = random.Random(seed)
    rows, want = [], {}
    for h in range(hosts):
        top, bottom = [f"site {h} top {k}" for k in range(3)], [f"site {h} end {k}" for k in range(2)]
        for k in range(pages):
            own = [brute.sentence(rng, 12) for _ in range(rng.randint(1, 6))]
            i = h * pages + k
            rows.append((i, f"http://h{h}.example/{rng.choice('abc')}/{k}?x=1", "".join(f"<div>{s}</div>" for s in [*top, *own, *bottom])))
            want[i] = "\n".join(own)
    rng.shuffle(rows)
    return rows, want


@pytest.mark.parametrize("parts", [1, 4, 12, 211])
def test_differencing_does_not_depend_on_parts(spark, parts):
    from spindle.llm.extraction import extract

    rows, want = site()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, PAGES).repartition(7)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == want


def test_article_markup_stripped(spark):
    """Of generated pages with an article element, differencing alone finds the text that the markup gives."""
    from spindle.llm.extraction import extract

    rng, rows, want = random.Random(4), [], {}
    for k in range(20):
        own = [brute.sentence(rng, 10) for _ in range(4)]
        rows.append((k, f"https://one.example/p/{k}", "<p>Welcome to the site</p><p>Read on below</p>@" + "".join(f"<p>{s}" for s in own) + "#<p>All rights are ours</p>"))
        want[k] = "\n".join(own)
    for tags in (("<article>", "</article>"), ("", "")):
        made = [(i, u, h.replace("@", tags[0]).replace("#", tags[1])) for i, u, h in rows]
        assert {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(made, PAGES)).collect()} == want


def test_common_lines_of_long_pages(monkeypatch):
    from spindle.llm import extraction

    rng = random.Random(5)
    for table in (1 << 27, 30):
        monkeypatch.setattr(extraction, "TABLE", table)
        for _ in range(60):
            x, y = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
            found = [x[k] for k in sorted(extraction.common(x, y))]
            rest = iter(y)
            assert len(found) == lcs(x, y) and all(c in rest for c in found)
    monkeypatch.setattr(extraction, "TABLE", 1 << 20)
    a = [f"line {k}" for k in range(6000)]
    b = [f"line {k}" if k % 3 else f"other {k}" for k in range(6000)]
    assert extraction.common(a, b) == {k for k in range(6000) if k % 3}


def test_a_very_long_page_beside_another(spark):
    from spindle.llm.extraction import extract

    long = "".join(f"<div>row {k}</div>" for k in range(20_000))
    rows = [(1, "http://l.example/a", "<div>top</div>" + long), (2, "http://l.example/b", "<div>top</div><div>short</div>"), (3, "http://l.example/c", "<div>top</div>" + "<aside>x" * 3000)]
    got = {r["page_id"]: r["n_chars"] for r in extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1] == len("\n".join(f"row {k}" for k in range(20_000))) and got[2] == len("short")


def test_clashing_columns_and_odd_rows(spark):
    from pyspark.sql import functions as F

    from spindle.llm.extraction import extract

    rows = [(None, "http://q.example/1", "<p>a"), (1, "http://q.example/2", "<p>a</p><p>b"), (1, "http://q.example/2", "<p>a</p><p>b"), (2, "no url", "<p>c"), (3, None, None)]
    df = spark.createDataFrame(rows, PAGES)
    for name in ("id", "host", "path", "part", "k", "h", "ghost", "z", "n"):
        df = df.withColumn(name, F.lit("x"))
    got = sorted(((r["page_id"], r["text"]) for r in extract(df).collect()), key=str)
    assert [x for x in got if x[0] in (2, 3)] == [(2, "c"), (3, "")] and len(got) == 5
