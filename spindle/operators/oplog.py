"""The change log: operations in order, their replay over a seed, and the latest word on each record."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "db_table string, pk string, row string, is_deleted int, applied long, conflicts long"


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; the order's columns decide, the later on ties of the first."""
    columns = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select(*key, "x.*")


def hidden(ops: DataFrame) -> DataFrame:
    """(db_table, pk): records whose last delete or restore is a delete."""
    last = latest(ops.where(F.col("op").isin("delete", "restore")), ["db_table", "pk"], ["seq"])
    return last.where("op = 'delete'").select("db_table", "pk")


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["seq"], kind="stable")
    state, applied, conflicts = None, 0, 0
    for r in rows.itertuples():
        value = json.loads(r.after) if r.after is not None and r.after == r.after else None
        if r.op == "seed":
            state = value | {"is_deleted": 0}
        elif r.op == "create":
            if state is None:
                state, applied = value | {"is_deleted": 0}, applied + 1
            else:
                conflicts += 1
        elif r.op == "update":
            before = json.loads(r.before) if r.before is not None and r.before == r.before else None
            if state is not None and r.field in state and state[r.field] == before:
                state[r.field], applied = value, applied + 1
            else:
                conflicts += 1
        elif r.op in ("delete", "restore"):
            applied += 1
            if state is not None:
                state["is_deleted"] = int(r.op == "delete")
    gone = None if state is None else state.pop("is_deleted")
    return pd.DataFrame([(rows["db_table"].iloc[0], rows["pk"].iloc[0], None if state is None else json.dumps(state, sort_keys=True), gone, applied, conflicts)], columns=["db_table", "pk", "row", "is_deleted", "applied", "conflicts"])


def replay(seed: DataFrame, ops: DataFrame) -> DataFrame:
    """Seed rows (db_table, pk, row as JSON) with the applied operations folded in, in order of seq.

    An update holds only if the live value is the one it was made against; else it is a conflict. A create of a record
    that exists is one too. Records without operations pass by the fold: only those with some are grouped.
    """
    touched = ops.select("db_table", "pk").distinct()
    still = seed.join(touched, ["db_table", "pk"], "left_anti").select("db_table", "pk", "row", F.lit(0).alias("is_deleted"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("conflicts"))
    base = seed.join(touched, ["db_table", "pk"], "left_semi").select("db_table", "pk", F.lit(-1).cast("long").alias("seq"), F.lit("seed").alias("op"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.col("row").alias("after"))
    log = ops.select("db_table", "pk", F.col("seq").cast("long").alias("seq"), "op", "field", "before", "after")
    return still.unionByName(base.unionByName(log).groupBy("db_table", "pk").applyInPandas(_fold, STATE))


def history(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Requests, newest first within a record, with their events nested in order."""
    nested = events.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "event", "by"))).alias("events"))
    newest = Window.partitionBy("db_table", "pk").orderBy(F.desc("created_at"), F.desc("request_id"))
    return requests.join(nested, "request_id", "left").withColumn("nth", F.row_number().over(newest))


