"""File sources and sinks: JSON lines, CSV, SQL dumps, Word packages, images, gazetteers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing file is an empty table, blank lines are none."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Columns in the order of their names."""
    df.select(sorted(df.columns)).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A flat mirror: nested columns as JSON, with a header."""
    flat = [F.to_json(F.col(c)).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType | T.StructType | T.MapType) else F.col(c) for c in sorted(df.columns)]
    df.select(flat).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


#: How a register is told from a file's or folder's name.
REGISTER = r"(?<!\d)(108\d{2}|1263bis|1262|1263)(?!\d)"


def register_of(name: F.Column) -> F.Column:
    found = F.regexp_extract(name, REGISTER, 1)
    return F.when(found != "", found)


def series_of(register: F.Column) -> F.Column:
    return F.when(register.startswith("108"), "Mercanzia").when(register.startswith("126"), "Camera di Commercio")


def word_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, extension, size, sha256, register_id, series) of the Word files below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{doc,docx}").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    register = register_of(F.col("path"))
    return found.select("path", F.lower(F.element_at(F.split(name, r"\."), -1)).alias("extension"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), register.alias("register_id"), series_of(register).alias("series"))


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, file, register_id, number, suffix, side_note) of the images below root; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").load(root).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    part = r"_0*(\d+)(bis)?([a-z])?(?:[^0-9a-zA-Z].*)?\.[A-Za-z]+$"
    number = F.regexp_extract(name, part, 1)
    return found.select("path", name.alias("file"), register_of(F.col("path")).alias("register_id"), F.when(number != "", number.cast("int")).alias("number"), F.regexp_extract(name, part, 2).alias("bis"), F.regexp_extract(name, part, 3).alias("suffix"))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(key, name, lat, lon, country, admin1, population): a row for each name of each populated or administrative place."""
    names = "geonameid name asciiname alternatenames lat lon feature_class feature_code country cc2 admin1 admin2 admin3 admin4 population".split()
    raw = spark.read.option("sep", "\t").option("quote", "").schema(", ".join(f"{n} string" for n in [*names, "e1", "e2", "e3", "e4"])).csv(path)
    good = raw.where(F.col("feature_class").isin("P", "A")).where(F.col("population").isNotNull())
    keys = F.array_distinct(F.transform(F.concat(F.array("name", "asciiname"), F.split(F.coalesce("alternatenames", F.lit("")), ",")), lambda n: F.trim(F.lower(n))))
    number = lambda c, t: F.expr(f"try_cast({c} AS {t})").alias(c)
    return good.select(F.explode(F.filter(keys, lambda k: k != "")).alias("key"), "name", number("lat", "DOUBLE"), number("lon", "DOUBLE"), "country", "admin1", number("population", "BIGINT")).where("lat is not null and lon is not null")


# SQL dumps


def statements(text: str, table: str) -> Iterator[str]:
    """The INSERT statements of a table, cut at semicolons outside quotes."""
    for m in re.finditer(rf"INSERT INTO `?{re.escape(table)}`?\s", text):
        at, quoted = m.start(), False
        for k in re.finditer(r"\\.|'|;", text[m.end() :], re.S):
            if k[0] == "'":
                quoted = not quoted
            elif k[0] == ";" and not quoted:
                yield text[at : m.end() + k.start()]
                break


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "Z": "\x1a"}
_VALUE = re.compile(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,()']+))\s*([,)])", re.S)


def tuples(statement: str) -> Iterator[list[str | None]]:
    """The value lists of an INSERT statement, escapes undone; NULL is None."""
    at = statement.upper().find("VALUES") + 6
    while (at := statement.find("(", at)) >= 0:
        at, row = at + 1, []
        while m := _VALUE.match(statement, at):
            at = m.end()
            if m[1] is not None:
                row.append(re.sub(r"\\(.)|''", lambda e: "'" if e[1] is None else _ESCAPES.get(e[1], e[1]), m[1], flags=re.S))
            else:
                row.append(None if m[2].strip().upper() == "NULL" else m[2].strip())
            if m[3] == ")":
                break
        yield row


def read_dump(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """A table of a SQL dump as text columns; a row of another width is an error, not a guess."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                rows = [r for s in statements(text, table) for r in tuples(s)]
                if any(len(r) != len(columns) for r in rows):
                    raise ValueError(f"{table}: a row does not have {len(columns)} values")
                yield pd.DataFrame(rows, columns=columns)

    return spark.read.text(path, wholetext=True).mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def dump_time(text: F.Column) -> F.Column:
    return F.nullif(F.regexp_extract(F.substring(text, 1, 2000), r"Generation Time:\s*([^\n\r]+)", 1), F.lit(""))


# Word packages

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPH = "path string, paragraph_index int, style string, current_text string, revision_text string, has_insertions boolean, has_deletions boolean, comment_ids array<string>, footnote_ids array<string>"


def _marked(node: ElementTree.Element, marked: bool) -> str:
    """Text of a paragraph as it now stands, or with <INS>, <DEL> ... around what was changed."""
    tag, out = node.tag.removeprefix(_W), []
    if tag == "t" or tag == "delText" and marked:
        return node.text or ""
    if tag in ("tab", "br"):
        return "\t" if tag == "tab" else "\n"
    if tag in ("del", "moveFrom") and not marked:
        return ""
    for child in node:
        out.append(_marked(child, marked))
    text = "".join(out)
    name = {"ins": "INS", "del": "DEL", "moveFrom": "MOVEFROM", "moveTo": "MOVETO"}.get(tag)
    if name and marked:
        told = "".join(f' {k}="{node.get(_W + k, "")}"' for k in ("id", "author", "date"))
        return f"<{name}{told}>{text}</{name}>"
    return text


def paragraphs(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for k, p in enumerate(root.iter(f"{_W}p")):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        ids = lambda name, p=p: [x.get(f"{_W}id") for x in p.iter(f"{_W}{name}")]
        yield k, None if style is None else style.get(f"{_W}val"), _marked(p, False), _marked(p, True), bool(ids("ins")), bool(ids("del")), ids("commentReference"), ids("footnoteReference")


def read_docx(spark: SparkSession, root: str) -> DataFrame:
    """Paragraphs of the Word packages below root, one package to a row at a time; a broken package gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARAGRAPH.split(", ")]
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, *p) for p in paragraphs(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(root)
    return found.select("path", "content").mapInPandas(run, PARAGRAPH)
