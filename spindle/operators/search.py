"""Full-text search: an inverted index as a DataFrame, all words of a query, ranked by BM25 over weighted fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_accents

K1, B, TITLE, BODY = 1.2, 0.75, 5.0, 1.0


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(fold_accents(F.coalesce(c, F.lit("")))), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame) -> DataFrame:
    """docs(kind, ref, title, body) -> (kind, ref, token, tf, len): tf is weighted by field, len counts all words."""
    split = docs.select("kind", "ref", tokens(F.col("title")).alias("t"), tokens(F.col("body")).alias("b"))
    split = split.withColumn("len", F.size("t") + F.size("b"))
    weighted = F.concat(F.transform("t", lambda w: F.struct(w.alias("token"), F.lit(TITLE).alias("w"))), F.transform("b", lambda w: F.struct(w.alias("token"), F.lit(BODY).alias("w"))))
    rows = split.select("kind", "ref", "len", F.explode(weighted).alias("x"))
    return rows.groupBy("kind", "ref", "len", F.col("x.token").alias("token")).agg(F.sum("x.w").alias("tf"))


def terms(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", query.lower())


def phrases(query: str) -> str:
    """A query in the index's own syntax: quoted phrases stay whole, other words are quoted, the last is a prefix."""
    out = [f'"{quoted}"' if quoted else f'"{word}"' for quoted, word in re.findall(r'"([^"]+)"|([^\s"]+)', query) if re.search(r"\w", quoted or word)]
    return " ".join(out[:-1] + [out[-1] + ("" if query.rstrip().endswith('"') else "*")]) if out else ""


def _counted(docs: DataFrame, words: list[str], prefix: bool) -> DataFrame:
    """docs with len, all words, and tf, the weighted uses of each word of a query; nothing is shuffled."""
    split = docs.select("kind", "ref", tokens(F.col("title")).alias("t"), tokens(F.col("body")).alias("b"))

    def uses(column: str, k: int, word: str) -> Column:
        return F.size(F.filter(column, lambda x: x.startswith(word) if prefix and k == len(words) - 1 else x == word))

    tf = F.array(*[uses("t", k, w) * TITLE + uses("b", k, w) * BODY for k, w in enumerate(words)])
    return split.select("kind", "ref", (F.size("t") + F.size("b")).alias("len"), tf.alias("tf"))


def search(docs: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(kind, ref, score): the k best documents of each kind that hold all words; the last word is a prefix.

    Document counts and the mean length are those of all kinds. An empty query finds nothing. One pass takes the
    totals, a second the documents whose folded text has all words at all; no word of a document is shuffled.
    """
    from pyspark.sql import Window

    words = terms(query)
    if not words:
        return docs.where("false").select("kind", "ref", F.lit(0.0).alias("score"))
    dfs = [F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(words))]
    size = _counted(docs, words, True).agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *dfs)
    folded = F.lower(fold_accents(F.concat_ws(" ", "title", "body")))
    able = docs
    for w in words:
        able = able.where(F.contains(folded, F.lit(w)))
    hits = _counted(able, words, True)
    for i in range(len(words)):
        hits = hits.where(F.get("tf", F.lit(i)) > 0)
    whole = hits.crossJoin(F.broadcast(size))  # one row of totals
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.get("tf", F.lit(i)), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    found = whole.select("kind", "ref", score.alias("score"))
    best = Window.partitionBy("kind").orderBy(F.desc(F.round("score", 9)), "ref")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("kind", "ref", F.round("score", 6).alias("score"))


def term_counts(docs: DataFrame, query: str, most: int = 6) -> DataFrame:
    """(term, docs): documents with each of the first words of a query, also of those without any."""
    words = list(dict.fromkeys(terms(query)))[:most]
    held = _counted(docs, words, False).agg(*[F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"n{i}") for i in range(len(words))])
    return held.select(F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.col(f"n{i}").alias("docs")) for i, w in enumerate(words)])).alias("x")).select("x.*")


def id_jump(archive, query: str) -> DataFrame:
    """(kind, ref): live acts, later acts and people whose id is the query; none unless it is a number."""
    number = int(query) if re.fullmatch(r"\d{1,18}", query.strip()) else None
    out = None
    for kind, rows, key in (("contract", archive.live_contract, "contract_id"), ("sub_contract", archive.live_sub_contract, "contract_id"), ("person", archive.live_person, "person_id")):
        found = rows.where(F.lit(False) if number is None else F.col(key) == number).select(F.lit(kind).alias("kind"), F.col(key).alias("ref"))
        out = found if out is None else out.unionByName(found)
    return out


def snippet(c: Column, words: list[str], size: int = 12) -> Column:
    """`size` words around the first that is one of words, which are marked; the first words where none is."""
    w = F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \n\t\r]+"), lambda x: x != "")
    places = [F.array_position(w, x) for x in words]
    met = F.least(*[F.when(p > 0, p) for p in places], F.lit(None).cast("long"))
    start = F.greatest(F.lit(1), F.coalesce(met, F.lit(1)) - 5).cast("int")
    shown = F.transform(F.slice(w, start, F.lit(size)), lambda x: F.when(x.isin(*words), F.concat(F.lit("«"), x, F.lit("»"))).otherwise(x))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.array_join(shown, " "), F.when(start + size - 1 < F.size(w), "…").otherwise(""))
