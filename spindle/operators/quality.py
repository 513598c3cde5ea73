"""Data-quality rules: each finds records a person should look at, and changes nothing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import has_key
from ..sources.archive import Archive

#: The label that reviewers see, and how grave each rule's finding is.
LABELS = {
    "broken_economic_sector": ("Broken economic sector", "high"),
    "missing_reg_date": ("Missing registration date", "high"),
    "no_partners": ("No partners recorded", "high"),
    "dup_partner": ("Possible duplicate partner", "medium"),
    "person_no_name": ("Unnamed person", "high"),
    "broken_place": ("Broken place", "high"),
    "guardian_no_ward": ("Guardian — ward not recorded", "medium"),
    "no_gp": ("No general partner", "medium"),
    "missing_sub_type": ("Act type missing", "medium"),
    "widow_not_woman": ("Marked widow, not a woman", "medium"),
}


def empty(name: str):
    """Null or the empty text; white space is text here."""
    return F.coalesce(F.col(name), F.lit("")) == ""


def undated(name: str = "registration_date"):
    return F.coalesce(F.col(name), F.lit("")).isin("", "0000-00-00")


def found(df: DataFrame, group: str, table: str, pk: str, suffix: str | None = None) -> DataFrame:
    """Flags (grp, db_table, pk, flag_key): a key is table:pk:group, with a suffix where a record may have several."""
    parts = [F.lit(table), F.col(pk).cast("string"), F.lit(group)] + ([F.col(suffix).cast("string")] if suffix else [])
    return df.select(F.lit(group).alias("grp"), F.lit(table).alias("db_table"), F.col(pk).alias("pk"), F.concat_ws(":", *parts).alias("flag_key"))


def broken_economic_sector(a: Archive) -> DataFrame:
    kinds = a.economic_activity.select(F.col("ec_activity_id").alias("economic_sector"))
    rows = a.live_contract.where(has_key("economic_sector")).join(kinds, "economic_sector", "left_anti")
    return found(rows, "broken_economic_sector", "contract", "contract_id")


def missing_reg_date(a: Archive) -> DataFrame:
    bare = a.live_contract.where(undated()).select("contract_id", "document")
    told = bare.where(~empty("document"))
    held = bare.where(empty("document")).join(a.live_investor.select("contract_id"), "contract_id", "left_semi")
    return found(told.unionByName(held), "missing_reg_date", "contract", "contract_id")


def no_partners(a: Archive) -> DataFrame:
    rows = a.live_contract.where(~empty("document")).join(a.live_investor.select("contract_id"), "contract_id", "left_anti")
    return found(rows, "no_partners", "contract", "contract_id")


def dup_partner(a: Archive) -> DataFrame:
    key = ["person_id", "contract_id"]
    mine = a.live_investor.select("investor_id", *key)
    twice = mine.where(has_key("person_id")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    links = a.live_investor_group.select("investor_id", "investment_id")
    sums = a.live_investment.select("investment_id", "type", "investment_cash")
    rows = mine.join(twice, key).join(a.contract.select("contract_id"), "contract_id", "left_semi").join(links, "investor_id", "left").join(sums, "investment_id", "left")
    stakes = ("type", "investment_id", "investment_cash")
    ends = rows.groupBy(key).agg(*(f(c).alias(f"{f.__name__}_{c}") for c in stakes for f in (F.min, F.max)))
    one = [F.col(f"min_{c}").eqNullSafe(F.col(f"max_{c}")) for c in stakes]  # no two values, nulls aside
    return found(ends.where(one[0] & one[1] & one[2]), "dup_partner", "contract", "contract_id", "person_id")


def person_no_name(a: Archive) -> DataFrame:
    rows = a.live_person.where(empty("first_name") & empty("last_name")).join(a.live_investor.select("person_id"), "person_id", "left_semi")
    return found(rows, "person_no_name", "person", "person_id")


def broken_place(a: Archive) -> DataFrame:
    known = a.place.select("place_id", F.lit(1).alias("known"))
    rows = a.live_investor.join(a.contract.select("contract_id"), "contract_id", "left_semi").select("investor_id", "contract_id", "place_of_residence", "place_of_origin")
    for field in ("place_of_residence", "place_of_origin"):
        rows = rows.join(known.select(F.col("place_id").alias(field), F.col("known").alias(f"known_{field}")), field, "left")
    lost = [has_key(f) & F.col(f"known_{f}").isNull() for f in ("place_of_residence", "place_of_origin")]
    return found(rows.where(lost[0] | lost[1]), "broken_place", "contract", "contract_id", "investor_id")


def guardian_no_ward(a: Archive) -> DataFrame:
    rows = a.live_investor.where("is_guardian = 1").where(empty("guardian_of")).join(a.contract.select("contract_id"), "contract_id", "left_semi")
    return found(rows, "guardian_no_ward", "contract", "contract_id", "investor_id")


def no_gp(a: Archive) -> DataFrame:
    rows = a.live_investor.select("investor_id", "contract_id").join(a.live_investor_group.select("investor_id", "investment_id"), "investor_id").join(a.live_investment.select("investment_id", "type"), "investment_id")
    none = rows.groupBy("contract_id").agg(F.count_if(F.col("type") == "gp").alias("gp")).where("gp = 0")
    return found(a.live_contract.join(none, "contract_id", "left_semi"), "no_gp", "contract", "contract_id")


def missing_sub_type(a: Archive) -> DataFrame:
    placeholder = (F.coalesce("main_contract_id", F.lit(0)) == 0) & undated() & empty("sub_firm_name")
    return found(a.live_sub_contract.where(empty("sub_type") & ~placeholder), "missing_sub_type", "sub_contract", "contract_id")


def widow_not_woman(a: Archive) -> DataFrame:
    widows = a.live_investor.where("is_widow = 1").select("person_id")
    return found(a.live_person.where("is_woman = 0").join(widows, "person_id", "left_semi"), "widow_not_woman", "person", "person_id")


RULES: list[Callable[[Archive], DataFrame]] = [broken_economic_sector, missing_reg_date, no_partners, dup_partner, person_no_name, broken_place, guardian_no_ward, no_gp, missing_sub_type, widow_not_woman]


def flags(a: Archive, dismissed: DataFrame | None = None) -> DataFrame:
    """All flags with their label and severity, without those whose key was dismissed."""
    rows = reduce(DataFrame.unionByName, [rule(a) for rule in RULES])
    if dismissed is not None:
        rows = rows.join(dismissed.select("flag_key"), "flag_key", "left_anti")
    for k, name in enumerate(("label", "severity")):
        rows = rows.withColumn(name, F.create_map(*[F.lit(x) for group, told in LABELS.items() for x in (group, told[k])])[F.col("grp")])
    return rows


# Integrity: what a maintainer should repair.


def cross_contract_link(a: Archive) -> DataFrame:
    links = a.live_investor_group.select("investor_id", "investment_id")
    rows = links.join(a.live_investor.select("investor_id", F.col("contract_id").alias("mine")), "investor_id").join(a.live_investment.select("investment_id", "contract_id"), "investment_id").where("mine <> contract_id")
    return found(rows, "cross_contract_link", "investor_group", "investor_id", "investment_id")


def subcontract_missing_parent(a: Archive) -> DataFrame:
    rows = a.live_sub_contract.where(has_key("main_contract_id")).join(a.contract.select(F.col("contract_id").alias("main_contract_id")), "main_contract_id", "left_anti")
    return found(rows, "subcontract_missing_parent", "sub_contract", "contract_id")


def incomplete_contract(a: Archive) -> DataFrame:
    rows = a.live_contract.where(empty("document")).join(a.live_investor.select("contract_id"), "contract_id", "left_anti")
    return found(rows, "incomplete_contract", "contract", "contract_id")


def _orphan(rows: DataFrame, parent: DataFrame, key: str, group: str, table: str, pk: str, suffix: str | None = None) -> DataFrame:
    return found(rows.join(parent.select(key), key, "left_anti"), group, table, pk, suffix)


def orphan_link_missing_investor(a: Archive) -> DataFrame:
    return _orphan(a.live_investor_group, a.investor, "investor_id", "orphan_link_missing_investor", "investor_group", "investor_id", "investment_id")


def orphan_link_missing_investment(a: Archive) -> DataFrame:
    return _orphan(a.live_investor_group, a.investment, "investment_id", "orphan_link_missing_investment", "investor_group", "investor_id", "investment_id")


def investment_missing_contract(a: Archive) -> DataFrame:
    return _orphan(a.live_investment, a.contract, "contract_id", "investment_missing_contract", "investment", "investment_id")


def contract_place_missing_contract(a: Archive) -> DataFrame:
    return _orphan(a.live_contract_place, a.contract, "contract_id", "contract_place_missing_contract", "contract_place", "contract_id", "place_id")


CHECKS: list[Callable[[Archive], DataFrame]] = [cross_contract_link, subcontract_missing_parent, incomplete_contract, orphan_link_missing_investor, orphan_link_missing_investment, investment_missing_contract, contract_place_missing_contract]


def report(a: Archive) -> DataFrame:
    """(grp, n): findings of each integrity check, also of those without any."""
    names = a.place.sparkSession.createDataFrame([(c.__name__,) for c in CHECKS], "grp string")
    rows = reduce(DataFrame.unionByName, [check(a) for check in CHECKS])
    return names.join(rows.groupBy("grp").agg(F.count("*").alias("n")), "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("n"))
