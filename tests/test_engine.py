"""The engine's own operators: expected values, and every query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("text, iso", [("addì 19 febbraio 1694 in Firenze", "1694-02-19"), ("25 marzo 1700", "1700-03-25"), ("10 febbraro 1550", "1550-02-10"), ("40 marzo 1700", None), ("3 brumaio 1700", None), ("nulla", None), ("4 gennaro 1691", "1691-01-04")])
def test_italian_date(spark, text, iso):
    from pyspark.sql import functions as F

    from spindle.functions.text import italian_date

    assert one(spark, italian_date(F.col("t")), t=text) == iso


def test_double_dates_and_stile(spark):
    from pyspark.sql import functions as F

    from spindle.functions.text import italian_dates, stile_fiorentino

    assert one(spark, italian_dates(F.col("t")), t="19 febbraio 1694/95 e 2 aprile 1600") == ["1600-04-02", "1694-02-19", "1695-02-19"]
    assert one(spark, stile_fiorentino(F.col("t")), t="1499-02-22") == "1500-02-22"
    assert one(spark, stile_fiorentino(F.col("t")), t="1499-03-25") is None
    assert one(spark, stile_fiorentino(F.col("t")), t="1750-01-02") is None


def test_signatures(spark):
    from pyspark.sql import functions as F

    from spindle.functions import text as tx

    sig = lambda f, t: one(spark, f(F.col("t")), t=t)
    assert sig(tx.activity_signature, "negotio di quoiaio") == sig(tx.activity_signature, "Cuoiaio e negozzio")
    assert sig(tx.activity_signature, "lanaiolo") != sig(tx.activity_signature, "linaiolo")
    assert sig(tx.title_signature, "Chiarissimo signore") == sig(tx.title_signature, "signor clarissimo")
    assert sig(tx.title_signature, "signora") != sig(tx.title_signature, "signori")
    assert sig(tx.place_signature, " Città , di Castello.") == "citta, di castello"
    assert sig(tx.match_text, "<b>Niccolò</b>, l'uno") == "niccolò l uno"


def test_folio_order(spark):
    from pyspark.sql import functions as F

    from spindle.functions.text import folio_key

    df = spark.createDataFrame([(f,) for f in ["142bisv", "c. 9r", "142v", "142r", "171(a)v", "9v", "n.n"]], "f string")
    assert [r["f"] for r in df.orderBy(folio_key(F.col("f"))).collect()] == ["n.n", "c. 9r", "9v", "142r", "142v", "142bisv", "171(a)v"]


def test_segments(spark):
    from pyspark.sql import functions as F

    from spindle.operators.sequence import segments

    kinds = ["context", "label", "body", "context", "context", "label", "body", "body"]
    df = spark.createDataFrame([("r", i, k) for i, k in enumerate(kinds)] + [("q", 0, "body")], "reg string, i int, kind string")
    got = [tuple(r) for r in segments(df, "reg", "i", F.col("kind") == "label", F.col("kind") == "context").orderBy("entry").collect()]
    assert got == [("r", 1, 0, 2, 3), ("r", 2, 3, 7, 5)]


def test_replay(spark):
    from spindle.operators.oplog import replay

    seed = spark.createDataFrame([("c", "1", '{"firm": "A"}'), ("c", "2", '{"firm": "B"}')], "db_table string, pk string, row string")
    ops = [("c", "1", 1, "update", "firm", '"A"', '"X"'), ("c", "1", 2, "update", "firm", '"A"', '"Y"'), ("c", "1", 3, "delete", None, None, None), ("c", "3", 4, "create", None, None, '{"firm": "N"}'), ("c", "3", 5, "create", None, None, '{"firm": "M"}')]
    log = spark.createDataFrame(ops, "db_table string, pk string, seq long, op string, field string, before string, after string")
    got = {r["pk"]: (r["row"], r["is_deleted"], r["applied"], r["conflicts"]) for r in replay(seed, log).collect()}
    assert got == {"1": ('{"firm": "X"}', 1, 2, 1), "2": ('{"firm": "B"}', 0, 0, 0), "3": ('{"firm": "N"}', 0, 1, 1)}


def test_classification(spark):
    from spindle.operators.linkage import classify, top

    schema = "entry_id string, row_id string, rule int, db_table string, main_contract_id long, registration_date string, folio_start string, folio_end string, strength double, signals array<string>, conflicts array<string>, score double"
    ids = ["contract_id_exact"]
    rows = [
        ("dual", "a", 0, "contract", 1, "d", "1r", "1v", 0.9, ids, [], 146.25), ("dual", "b", 0, "sub_contract", 2, "d", "1r", "1v", 0.9, ids, [], 140.78), ("dual", "c", 0, "contract", 3, "d", "1r", "1v", 0.1, [], [], 32.91),
        ("multi", "a", 0, "sub_contract", 7, "d", "1r", "1v", 0.5, [], [], 120.0), ("multi", "b", 0, "sub_contract", 7, "d", "1r", "1v", 0.5, [], [], 118.0),
        ("high", "a", 0, "contract", 7, "d", None, None, 0.5, [], [], 90.0), ("cand", "a", 0, "contract", 7, "d", None, None, 0.5, [], ["folio_differs"], 90.0),
        ("amb", "a", 0, "contract", 7, "d", None, None, 0.5, [], [], 50.0), ("amb", "b", 0, "contract", 8, "d", None, None, 0.5, [], [], 49.0), ("none", "a", 0, "contract", 8, "d", None, None, 0.0, [], [], 5.0),
    ]
    got = {r["entry_id"]: r["status"] for r in classify(top(spark.createDataFrame(rows, schema))).collect()}
    assert got == {"dual": "matched_high_confidence", "multi": "matched_multiple", "high": "matched_high_confidence", "cand": "matched_candidate", "amb": "ambiguous", "none": "word_only"}


def test_search(spark):
    from spindle.operators.search import search

    docs = spark.createDataFrame([("contract", 1, "Salviati", "banco di Firenze"), ("contract", 2, "", "Salviatí lana"), ("person", 3, "battiloro", "")], "kind string, ref long, title string, body string")
    assert [r["ref"] for r in search(docs, "salviati").orderBy("ref").collect()] == [1, 2]
    assert [r["ref"] for r in search(docs, "salv").orderBy("ref").collect()] == [1, 2]
    assert search(docs, "salviati battiloro").collect() == [] == search(docs, " - ").collect()


def test_builder_refuses(spark):
    from spindle.operators.builder import compile_spec
    from spindle.sources.archive import Archive

    a = Archive(spark, SF)
    for spec in ({}, {"subject": "contracts", "measure": "x"}, {"subject": "investors", "measure": "sum_total"}, {"subject": "contracts", "filters": [{"id": "role_gp"}]}, {"subject": "contracts", "filters": [{"id": "place_is"}]}, {"subject": "investors", "group_by": "currency"}):
        with pytest.raises(ValueError):
            compile_spec(a, spec)


def test_read_only(spark):
    from spindle.operators.builder import run_read_only

    spark.range(20).createOrReplaceTempView("numbers")
    out = run_read_only(spark, "WITH x AS (SELECT id FROM numbers) SELECT count(*) AS n FROM x UNION ALL SELECT 1", cap=1)
    assert out == {"columns": ["n"], "rows": [[20]], "row_count": 1, "truncated": True}
    assert run_read_only(spark, "SELECT 'update' AS word")["rows"] == [["update"]]
    for sql in ("DROP VIEW numbers", "INSERT INTO numbers VALUES (1)", "CREATE TABLE t AS SELECT 1", "SELECT 1; SELECT 2", "SELEC 1", "SET x = 1"):
        with pytest.raises(ValueError):
            run_read_only(spark, sql)


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def test_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as entry
    from spindle.plans import registry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries = entry.queries()
    for name, sql in registry.ORACLE_SQL.items():
        df = queries[name](spark, SF)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names), name
        a = sorted("|".join(norm(r[c]) for c in sorted(names)) for r in df.collect())
        b = sorted("|".join(norm(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
        assert a == b, name


def test_rest_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/spindle", f"{tmp_path}/spindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'per_year' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
