"""File sources: what is written is read again."""

import zipfile

from pyspark.sql import functions as F

from spindle.sources import files


def test_json_lines(spark, tmp_path):
    schema = "b string, a array<int>"
    assert files.read_jsonl(spark, f"{tmp_path}/none", schema).collect() == []
    df = spark.createDataFrame([("x", [1, 2]), (None, None)], schema)
    files.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(map(str, files.read_jsonl(spark, f"{tmp_path}/j", schema).collect())) == sorted(map(str, df.collect()))
    files.write_csv(df.where("b is not null"), f"{tmp_path}/c")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c").collect()] == [("[1,2]", "x")]


def test_dump(spark, tmp_path):
    text = "-- Generation Time: Jan 1, 2020\nINSERT INTO `person` (`id`, `name`) VALUES\n(1, 'L\\'oro; di ''Pisa'''),\n(2, NULL),(3, 'a\\nb (c), d');\nINSERT INTO `other` VALUES (9, 'x');\nINSERT INTO `person` VALUES (4, '');"
    (tmp_path / "d.sql").write_text(text)
    got = [tuple(r) for r in files.read_dump(spark, str(tmp_path / "d.sql"), "person", ["id", "name"]).collect()]
    assert got == [("1", "L'oro; di 'Pisa'"), ("2", None), ("3", "a\nb (c), d"), ("4", "")]
    when = spark.read.text(str(tmp_path / "d.sql"), wholetext=True).select(files.dump_time(F.col("value")))
    assert when.first()[0] == "Jan 1, 2020"


def test_docx_and_listings(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Uno </w:t></w:r><w:ins w:id="1" w:author="A" w:date="D"><w:r><w:t>due</w:t></w:r></w:ins><w:del w:id="2"><w:r><w:delText>tre</w:delText></w:r></w:del><w:r><w:footnoteReference w:id="5"/></w:r></w:p></w:body></w:document>'
    (tmp_path / "10832").mkdir()
    with zipfile.ZipFile(tmp_path / "10832" / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "10832" / "b.docx").write_bytes(b"broken")
    (r,) = files.read_docx(spark, str(tmp_path)).collect()
    assert (r["current_text"], r["style"], r["has_insertions"], r["footnote_ids"]) == ("Uno due", "H", True, ["5"])
    assert r["revision_text"] == 'Uno <INS id="1" author="A" date="D">due</INS><DEL id="2" author="" date="">tre</DEL>'
    assert {(x["extension"], x["register_id"], x["series"]) for x in files.word_files(spark, str(tmp_path)).collect()} == {("docx", "10832", "Mercanzia")}
    for n in ("r_074.jpg", "r_074bis.jpg", "r_081a.jpg", "cover.jpg"):
        (tmp_path / "10832" / n).write_bytes(b"x")
    got = {x["file"]: (x["number"], x["bis"], x["suffix"]) for x in files.images(spark, str(tmp_path)).collect()}
    assert got == {"r_074.jpg": (74, "", ""), "r_074bis.jpg": (74, "bis", ""), "r_081a.jpg": (81, "", "a"), "cover.jpg": (None, "", "")}


def test_gazetteer(spark, tmp_path):
    row = ["1", "Città", "Citta", "Civitas,", "43.1", "12.2", "P", "PPL", "IT", "", "16", "", "", "", "100", "", "", "", ""]
    bad = ["2", "x"]
    (tmp_path / "g.tsv").write_text("\n".join("\t".join(r) for r in (row, bad, [*row[:6], "H", *row[7:]])))
    assert {r["key"] for r in files.gazetteer(spark, str(tmp_path / "g.tsv")).collect()} == {"città", "citta", "civitas"}


def test_vocabulary(spark):
    from spindle.operators import vocabulary as v

    terms = spark.createDataFrame([(1, "signore", 3), (2, "Signor", 9), (3, "messer", 1)], "id long, value string, count long")
    (f,) = v.families(terms, "title").collect()
    assert (f["signature"], [t["id"] for t in f["terms"]], f["total"]) == ("signor", [2, 1], 12)
    members = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("c", 6), ("c", 7)], "family string, id long")
    links = spark.createDataFrame([("same_as", 1, 2), ("variant_of", 3, 2), ("distinct", 5, 4), ("same_as", 6, 1)], "rel string, from_id long, to_id long")
    assert [r["family"] for r in v.undecided(members, links).collect()] == ["c"]
    names = spark.createDataFrame([(1, "Città", "IT", "Umbria"), (2, "Pisa", "FR", None), (3, "Ignota", None, None)], "id long, name string, country string, region string")
    entries = spark.createDataFrame([("citta", "IT", 1.0, 2.0, "Lazio", 900), ("citta", "IT", 3.0, 4.0, "umbria", 5), ("pisa", "IT", 5.0, 6.0, "", 1)], "key string, country string, lat double, lon double, admin1 string, population long")
    points = v.nearest_entry(names, entries)
    centre = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "id long, lat double, lon double")
    got = {r["id"]: (r["lat"], r["precision"]) for r in v.waterfall(names, ("gazetteer", points), ("country", centre)).collect()}
    assert got == {1: (3.0, "gazetteer"), 2: (9.0, "country"), 3: (None, None)}
