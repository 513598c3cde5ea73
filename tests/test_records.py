"""The console's guard, revision tokens, labels, folios and search syntax on literal cases."""

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT reflect('java.lang.System', 'nanoTime') FROM held",
        "SELECT id FROM held WHERE id IN (SELECT reflect('java.lang.System', 'nanoTime'))",
        "SELECT * FROM text.`/etc/hosts`",
        "SELECT (SELECT max(value) FROM text.`/etc/hosts`) AS x FROM held",
        "WITH c AS (SELECT * FROM text.`/etc/hosts`) SELECT * FROM c",
        "SELECT h.id FROM held h JOIN text.`/etc/hosts` t ON true",
        "DROP VIEW held",
        "SELECT 1; SELECT 2",
    ],
)
def test_console_refuses(spark, sql):
    from spindle.operators.builder import run_read_only

    spark.range(3).createOrReplaceTempView("held")
    with pytest.raises(ValueError):
        run_read_only(spark, sql)


def test_console_reads_views(spark, tmp_path):
    from spindle.operators.builder import run_read_only

    spark.range(5).write.parquet(f"{tmp_path}/t")
    spark.read.parquet(f"{tmp_path}/t").createOrReplaceTempView("kept")
    got = run_read_only(spark, "WITH a AS (SELECT id FROM kept WHERE id > (SELECT min(id) FROM kept)) SELECT a.id, count(*) AS n FROM a JOIN kept k ON k.id <= a.id GROUP BY 1 ORDER BY 1", cap=3)
    assert got["rows"] == [[1, 2], [2, 3], [3, 4]] and got["truncated"]


def test_revision_tokens(spark):
    from spindle.operators.revisions import tokens

    made = tokens('a<INS id="1" author="G" date="2020">b<DEL id="2">c</INS>d\te</DEL><COMMENT_START id="7">f<COMMENT_END id="7"><COMMENT_REF id="7"/><ENDNOTE_REF id="3"/></MOVETO>')
    shown = [(t["text"], [c["tag"] for c in t["changes"]], t["comment_ids"]) for t in made["tokens"] if t["type"] == "text"]
    assert shown == [("a", [], []), ("b", ["INS"], []), ("c", ["INS", "DEL"], []), ("d", ["DEL"], []), ("e", ["DEL"], []), ("f", [], ["7"])]
    assert [t["type"] for t in made["tokens"] if t["type"] != "text"] == ["tab", "comment_ref", "note_ref"]
    assert {k: made[k] for k in ("insertions", "deletions", "moves", "comments", "notes")} == {"insertions": 1, "deletions": 1, "moves": 0, "comments": 1, "notes": 1}
    assert made["tokens"][1]["changes"] == [{"tag": "INS", "kind": "insertion", "id": "1", "author": "G", "date": "2020"}]
    assert tokens("") == {"tokens": [], "insertions": 0, "deletions": 0, "moves": 0, "comments": 0, "notes": 0}


def test_folios(spark):
    from spindle.functions import text as tx

    rows = [("94r[ORIG.93r]", "94r", "94r"), ("118v-119r/117v-118r", "118v", "119r"), ("76v=774", "76v", "76v"), ("24rv", "24r", "24v"), ("12r-v", "12r", "12v"), ("142bisv", "142bisv", "142bisv"), ("171(a)r", "171(a)r", "171(a)r"), ("n.n", "n.n", "n.n"), ("", None, None)]
    got = spark.createDataFrame(rows, "f string, s string, e string").select(tx.db_folio(F.col("f")).alias("x"), "s", "e").collect()
    assert [(r["x"]["start"], r["x"]["end"]) for r in got] == [(r["s"], r["e"]) for r in got]
    spans = [("1r", "3v", "2r", None, "within"), ("1r", "2v", "2v", "4r", "overlap"), ("1r", None, "2r", None, "off_by_one"), ("1r", None, "5r", None, "different"), (None, None, "5r", None, "missing"), ("n.n", None, "n.n", None, "exact"), ("12v", None, "12v", "12v", "exact")]
    df = spark.createDataFrame(spans, "a string, b string, c string, d string, want string")
    assert all(r["got"] == r["want"] for r in df.select(tx.folio_relation(*map(F.col, "abcd")).alias("got"), "want").collect())


def test_search_syntax():
    from spindle.operators.search import phrases

    assert phrases('seta "arte della" lan') == '"seta" "arte della" "lan"*'
    assert phrases('"arte della lana"') == '"arte della lana"' and phrases(" - ") == ""
