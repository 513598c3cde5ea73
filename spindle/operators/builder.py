"""Analyses from a specification, compiled to DataFrames, and a read-only SQL console."""

from __future__ import annotations

import json
import threading
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import blank_date, decade, year
from ..sources.archive import Archive

CAP, DEADLINE = 5000, 6.0


def _contracts(a: Archive) -> DataFrame:
    return a.live_contract


def _investors(a: Archive) -> DataFrame:
    acts = a.live_contract.select("contract_id", "registration_date", "firm_name")
    people = a.person.select("person_id", "first_name", "last_name", "is_woman")
    return a.live_investor.join(people, "person_id").join(acts, "contract_id")


def _semi(key: str, rows) -> Any:
    return lambda a, df, v: df.join(rows(a, v).select(key), key, "left_semi")


def _anti(key: str, rows) -> Any:
    return lambda a, df, v: df.join(rows(a).select(key), key, "left_anti")


def _where(condition) -> Any:
    return lambda a, df, v: df.where(condition(v))


def _role(role: str):
    def rows(a: Archive, v) -> DataFrame:
        return a.investor_group.select("investor_id", "investment_id").join(a.live_investment.where(F.col("type") == role).select("investment_id"), "investment_id")

    return rows



def _year_text():
    return F.substring("registration_date", 1, 4)


SUBJECTS = {"contracts": (_contracts, ["contract_id", "registration_date", "firm_name"]), "investors": (_investors, ["contract_id", "registration_date", "first_name", "last_name"])}
#: filter -> (subjects, whether it needs a value, function of (archive, rows, value))
FILTERS = {
    "reg_year_from": (("contracts", "investors"), True, _where(lambda v: _year_text() >= str(v))),
    "reg_year_to": (("contracts", "investors"), True, _where(lambda v: _year_text() <= str(v))),
    "place_is": (("contracts",), True, _semi("contract_id", lambda a, v: a.live_contract_place.join(a.place.where(F.col("place_name") == v), "place_id"))),
    "activity_contains": (("contracts",), True, _semi("economic_sector", lambda a, v: a.economic_activity.where(F.col("activity").ilike(f"%{v}%")).select(F.col("ec_activity_id").alias("economic_sector")))),
    "currency_is": (("contracts",), True, _semi("currency_id", lambda a, v: a.currency.where(F.col("currency") == v))),
    "register_is": (("contracts",), True, _where(lambda v: F.trim("folder") == v)),
    "ec_discretion_yes": (("contracts",), False, _where(lambda v: F.col("ec_discretion") == 1)),
    "no_place": (("contracts",), False, _anti("contract_id", lambda a: a.live_contract_place)),
    "no_investors": (("contracts",), False, _anti("contract_id", lambda a: a.live_investor)),
    "gender_women": (("investors",), False, _where(lambda v: F.col("is_woman") == 1)),
    "gender_men": (("investors",), False, _where(lambda v: F.col("is_woman") == 0)),
    "role_gp": (("investors",), False, _semi("investor_id", _role("gp"))),
    "role_lp": (("investors",), False, _semi("investor_id", _role("lp"))),
    "via_proxy": (("investors",), False, _where(lambda v: F.col("via_proxy") == 1)),
    "jewish": (("investors",), False, _where(lambda v: (F.col("is_jewish") == 1) | (F.col("jewish_db") == 1))),
    "title_contains": (("investors",), True, _semi("title", lambda a, v: a.title.where(F.col("title_name").ilike(f"%{v}%")).select(F.col("title_id").alias("title")))),
}
GROUPS = {
    "reg_year": (("contracts", "investors"), lambda: year("registration_date")),
    "decade": (("contracts", "investors"), lambda: decade("registration_date")),
    "currency": (("contracts",), lambda: F.col("currency")),
    "register": (("contracts",), lambda: F.trim("folder")),
    "gender": (("investors",), lambda: F.when(F.col("is_woman") == 1, "women").otherwise("men")),
}
MEASURES = ("count", "list", "sum_total", "avg_total")


def compile_spec(a: Archive, spec: dict[str, Any]) -> DataFrame:
    """{subject, measure, filters: [{id, value}], group_by} -> a DataFrame; ValueError for anything else."""
    subject, measure, group = spec.get("subject"), spec.get("measure", "count"), spec.get("group_by") or None
    if subject not in SUBJECTS:
        raise ValueError(f"unknown subject {subject!r}")
    if measure not in MEASURES or measure in ("sum_total", "avg_total") and subject != "contracts":
        raise ValueError(f"unknown measure {measure!r} of {subject}")
    rows, columns = SUBJECTS[subject]
    df = rows(a)
    for f in spec.get("filters") or []:
        on, needs, apply = FILTERS.get(f.get("id"), ((), False, None))
        if subject not in on:
            raise ValueError(f"unknown filter {f.get('id')!r} of {subject}")
        if needs and f.get("value") in (None, ""):
            raise ValueError(f"filter {f['id']!r} needs a value")
        df = apply(a, df, f.get("value"))
    if measure == "list":
        return df.select(columns).orderBy(columns).limit(CAP)
    key = None
    if group:
        on, key = GROUPS.get(group, ((), None))
        if subject not in on:
            raise ValueError(f"unknown group {group!r} of {subject}")
        if group in ("reg_year", "decade"):
            df = df.where(~blank_date("registration_date"))
        if group == "currency":
            df = df.join(F.broadcast(a.currency), "currency_id")
        key = key().alias(group)
    if measure == "count":
        out = F.count("*").alias("n")
    else:
        df = df.where(F.col("total").rlike("^[0-9]"))
        amount = F.expr("try_cast(regexp_extract(total, '^ *([+-]?[0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE)")
        out = F.round(F.sum(amount) if measure == "sum_total" else F.avg(amount), 0 if measure == "sum_total" else 2).alias(measure)
    return df.groupBy(key).agg(out) if key is not None else df.agg(out)


def _walk(nodes: Any):
    """The nodes of a plan as JSON, also those of subqueries inside expressions, but not what stands behind a view."""
    at = 0

    def one() -> Any:
        nonlocal at
        node = nodes[at]
        at += 1
        hidden = node["class"].endswith(".logical.View")
        if not hidden:
            yield node
            for x in node.values():
                for part in x if isinstance(x, list) else [x]:
                    if isinstance(part, list) and part and isinstance(part[0], dict) and "class" in part[0]:
                        yield from _walk(part)
                if isinstance(x, list) and x and isinstance(x[0], dict) and "class" in x[0]:
                    yield from _walk(x)
        for _ in range(node["num-children"]):
            yield from ([] if hidden and not list(one()) else [] if hidden else one())

    while at < len(nodes):
        yield from one()


def check_reads(plan: list[dict]) -> None:
    """ValueError unless an analysed plan reads registered views alone and calls functions of the engine alone."""
    for node in _walk(plan):
        kind = node["class"]
        if ".catalyst.plans.logical." in kind:
            continue
        if ".catalyst.plans." in kind and not kind.endswith("Relation"):
            continue
        if not kind.startswith("org.apache.spark.sql.catalyst.expressions."):
            raise ValueError("only registered views may be read")
        if kind.rsplit(".", 1)[1] in ("CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF", "PythonUDAF", "InputFileName", "Invoke", "StaticInvoke"):
            raise ValueError("this function is not allowed")


def run_read_only(spark: SparkSession, sql: str, cap: int = CAP, deadline: float = DEADLINE) -> dict[str, Any]:
    """One query, parsed and refused unless it only reads; at most cap rows, interrupted after the deadline.

    -> {columns, rows, row_count, truncated}; ValueError with the reason otherwise.
    """
    text = sql.strip().rstrip(";")
    if ";" in text:
        raise ValueError("one statement only")
    jvm = spark._jsparkSession
    try:
        plan = jvm.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValueError(f"SQL error: {str(e).splitlines()[0]}") from e
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getName()
        if ".plans.logical." not in name or any(x in name for x in ("Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Set", "Command", "Cache", "Truncate", "Load")) and not name.endswith("SetOperation"):
            if ".catalyst.analysis." not in name:
                raise ValueError("only queries are allowed")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    tag = f"read-only-{id(plan)}"
    spark.addTag(tag)
    late: list[bool] = []
    timer = threading.Timer(deadline, lambda: (late.append(True), spark.interruptTag(tag)))
    timer.start()
    try:
        df = spark.sql(text)
        check_reads(json.loads(df._jdf.queryExecution().analyzed().toJSON()))
        rows = df.limit(cap + 1).collect()
    except ValueError:
        raise
    except Exception as e:
        raise ValueError("timed out" if late else f"SQL error: {str(e).splitlines()[0]}") from e
    finally:
        timer.cancel()
        spark.removeTag(tag)
    return {"columns": df.columns, "rows": [list(r) for r in rows[:cap]], "row_count": min(len(rows), cap), "truncated": len(rows) > cap}
