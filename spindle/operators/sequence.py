"""Order-dependent computations: carry-forward, segmentation, collisions of keys, best and latest rows, margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, by: str, order: str, value: str, out: str) -> DataFrame:
    """The last non-null value at or before each row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def segments(df: DataFrame, by: str, order: str, label: Column, context: Column) -> DataFrame:
    """(by, entry, first_index, last_index, rows) of the entries that label rows open.

    An entry begins at its label or at the run of context rows before it, and ends before the next entry; context rows
    at its end belong to the next only if a label follows them. Rows before the first entry belong to none.
    """
    x = df.select(F.col(by).alias("k"), F.col(order).alias("i"), label.alias("label"), context.alias("context"))
    w, b = Window.partitionBy("k").orderBy("i"), Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("i").over(Window.partitionBy("k"))
    x = x.withColumn("stop", F.max(F.when(F.col("label") | ~F.col("context"), F.col("i"))).over(b)).withColumn("first", first)
    starts = x.where("label").select("k", F.coalesce(F.col("stop") + 1, F.col("first")).cast("long").alias("start"))
    marks = x.join(starts.distinct().withColumnRenamed("start", "i").withColumn("opens", F.lit(1)), ["k", "i"], "left")
    marks = marks.withColumn("entry", F.sum(F.coalesce("opens", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marks.where("entry > 0").groupBy(F.col("k").alias(by), F.col("entry").cast("long").alias("entry")).agg(F.min("i").alias("first_index"), F.max("i").alias("last_index"), F.count("*").alias("rows"))


def unique_keys(df: DataFrame, key: str, content: str, order: str, out: str) -> DataFrame:
    """Keys that collide get _hash8 of the content, those that still do _n in order. Collisions are counted by partial
    sums; only rows of equal key and content meet in a window, without their content."""
    rows = df.select(F.col(key).alias("_key"), F.col(order).alias("_at"), F.substring(F.sha2(F.col(content), 256), 1, 8).alias("_h"))
    many = rows.groupBy("_key").agg(F.count("*").alias("_n"))
    rows = rows.join(many, "_key").withColumn("_k", F.when(F.col("_n") > 1, F.concat_ws("_", "_key", "_h")).otherwise(F.col("_key")))
    nth = F.row_number().over(Window.partitionBy("_k").orderBy("_at")) - 1
    named = rows.withColumn(out, F.when(nth > 0, F.concat("_k", F.lit("_"), nth.cast("string"))).otherwise(F.col("_k")))
    return named.select(F.col("_at").alias(order), out)


def best(df: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """The row of the highest score of each key, the first on ties; an aggregate, so no key's rows meet in one task."""
    columns = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(F.col(score), -F.col(order))).alias("x")).select(*by, "x.*")


def margins(df: DataFrame, by: str, score: str, order: str, k: int = 5) -> DataFrame:
    """The k best rows of each key with their rank and the score's distance to the next."""
    w = Window.partitionBy(by).orderBy(F.desc(score), order)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col(score) - F.lead(score).over(w)).where(F.col("rank") <= k)


def majority(df: DataFrame, by: list[str], variant: str) -> DataFrame:
    """The most frequent variant of each key (the greatest on ties) and the count over all variants."""
    per = df.groupBy(*by, variant).agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.max_by(variant, F.struct("n", variant)).alias(variant), F.sum("n").alias("n"))


def presence(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Which of the parts have each key: a full outer join of their distinct keys."""
    out = None
    for name, df in parts.items():
        one = df.select(key).distinct().withColumn(f"{name}_present", F.lit(True))
        out = one if out is None else out.join(one, key, "full_outer")
    return out.select(key, *(F.coalesce(f"{n}_present", F.lit(False)).alias(f"{n}_present") for n in parts))
