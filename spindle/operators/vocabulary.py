"""Vocabulary terms: families by signature, what is left to decide in them, and places on the map."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.currency import currency_signature, currency_skeleton
from ..functions.text import activity_signature, lookup_key, place_signature, title_signature

#: A signature for each kind of term.
MATCHERS = {"currency": currency_signature, "activity": activity_signature, "title": title_signature, "place": place_signature}


def families(terms: DataFrame, kind: str) -> DataFrame:
    """terms(id, value, count) -> (signature, terms sorted by use, total) of signatures that several ids share."""
    grouped = terms.withColumn("signature", MATCHERS[kind](F.col("value"))).where("signature <> ''").groupBy("signature")
    found = grouped.agg(F.countDistinct("id").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "id", "value", "count"))).alias("terms"), F.sum("count").alias("total"))
    return found.where("n > 1").select("signature", F.transform("terms", lambda t: F.struct(t["id"].alias("id"), t["value"].alias("value"), t["count"].alias("count"))).alias("terms"), "total")


def currency_cautions(terms: DataFrame) -> DataFrame:
    """terms(id, value, count) -> (skeleton, terms, total): currencies that differ in their rate alone and must not be joined.

    Of each signature with a figure the most used term stands for it (the smallest id on ties), so what is gathered for a
    skeleton is one term for each rate.
    """
    t = terms.withColumns({"signature": currency_signature(F.col("value")), "skeleton": currency_skeleton(F.col("value"))}).where("contains(signature, '=')")
    most = t.groupBy("skeleton", "signature").agg(F.min(F.struct((-F.col("count")).alias("order"), "id", "value", "count")).alias("t"))
    found = most.groupBy("skeleton").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("t")).alias("terms"), F.sum("t.count").alias("total"))
    return found.where("n > 1").select("skeleton", F.transform("terms", lambda x: F.struct(x["id"].alias("id"), x["value"].alias("value"), x["count"].alias("count"))).alias("terms"), "total")


def undecided(members: DataFrame, links: DataFrame) -> DataFrame:
    """Families in which some pair is neither joined (same_as, variant_of, also through others) nor called distinct.

    members(family, id); links(rel, from_id, to_id), active ones. Families are small; each is looked at in one group.
    """

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({int(i) for i in rows["id"]})
        up = {i: i for i in ids}

        def root(x: int) -> int:
            while up[x] != x:
                x = up[x]
            return x

        apart = set()
        for r in rows.itertuples():
            if r.rel == r.rel and r.rel is not None and int(r.other) in up:
                if r.rel == "distinct":
                    apart.add(frozenset((int(r.id), int(r.other))))
                else:
                    up[root(int(r.id))] = root(int(r.other))
        left = any(root(a) != root(b) and frozenset((a, b)) not in apart for k, a in enumerate(ids) for b in ids[k + 1 :])
        return pd.DataFrame({"family": pd.Series([rows["family"].iloc[0]] * left, dtype=object)})

    ends = links.select("rel", F.col("from_id").alias("id"), F.col("to_id").alias("other"))
    return members.join(ends, "id", "left").select("family", F.col("id").cast("double"), "rel", F.col("other").cast("double")).groupBy("family").applyInPandas(look, "family string")


def nearest_entry(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """names(id, name, country, region) with the best gazetteer entry of that name and country: the region first, then size."""
    entries = gazetteer.select(F.col("key"), F.col("country").alias("c"), "lat", "lon", F.lower("admin1").alias("admin"), "population")
    found = names.withColumn("key", lookup_key(F.col("name"))).join(entries, "key").where(F.col("country").isNull() | (F.col("c") == F.col("country")))
    region = F.lower("region")
    agrees = F.coalesce(F.contains(F.col("admin"), region) | F.contains(region, F.col("admin")), F.lit(False))
    best = Window.partitionBy("id").orderBy(F.desc(agrees), F.desc("population"), "lat", "lon")
    return found.withColumn("n", F.row_number().over(best)).where("n = 1").select("id", "lat", "lon")


def waterfall(names: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """names(id, ...) with the point of the first source (name, (id, lat, lon)) that has one, and which it was."""
    out = names
    for name, points in sources:
        out = out.join(points.select("id", F.col("lat").alias(f"lat_{name}"), F.col("lon").alias(f"lon_{name}")), "id", "left")

    def pick(part: str) -> Column:
        return F.coalesce(*(F.col(f"{part}_{name}") for name, _ in sources))

    precision = F.coalesce(*(F.when(F.col(f"lat_{name}").isNotNull(), F.lit(name)) for name, _ in sources))
    return out.select(*names.columns, pick("lat").alias("lat"), pick("lon").alias("lon"), precision.alias("precision"))
