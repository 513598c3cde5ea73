"""Records as a reader sees them: an act with its people, stakes and places, a person with their acts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_document, display_name, display_text, lookup_key, yes_no
from ..sources.archive import Archive


def joined(c: str):
    """Distinct texts of a group, sorted, as one text."""
    return F.array_join(F.array_sort(F.collect_set(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c)))), "; ")


def contract_detail(a: Archive) -> DataFrame:
    """A live act with what its keys name, its places, and how many people, stakes and later acts it has."""
    places = a.live_contract_place.join(a.place, "place_id").groupBy("contract_id").agg(joined("place_name").alias("places"))
    people = a.live_investor.groupBy("contract_id").agg(F.count("*").alias("investors"))
    later = a.live_sub_contract.groupBy(F.col("main_contract_id").alias("contract_id")).agg(F.count("*").alias("later_acts"))
    coin = a.currency.groupBy("currency_id").agg(F.min("currency").alias("currency"))
    kind = a.economic_activity.select(F.col("ec_activity_id").alias("economic_sector"), "activity")
    out = a.live_contract.join(coin, "currency_id", "left").join(kind, "economic_sector", "left")
    for part in (places, people, later):
        out = out.join(part, "contract_id", "left")
    return out.select("contract_id", display_text(F.col("firm_name")).alias("firm"), display_text(F.nullif("registration_date", F.lit("0000-00-00"))).alias("registered"), display_text(F.col("currency")).alias("currency"), display_text(F.col("activity")).alias("activity"), yes_no(F.col("ec_discretion")).alias("discretion"), display_text(F.col("places")).alias("places"), F.coalesce("investors", F.lit(0)).alias("investors"), F.coalesce("later_acts", F.lit(0)).alias("later_acts"))


def sub_contract_detail(a: Archive) -> DataFrame:
    """A live later act with the firm and date of the act that it belongs to, and its text with real line ends."""
    parent = a.contract.select(F.col("contract_id").alias("main_contract_id"), F.col("firm_name").alias("main_firm"), F.col("registration_date").alias("main_date"))
    rows = a.live_sub_contract.join(parent, "main_contract_id", "left")
    return rows.select("contract_id", "main_contract_id", display_text(F.col("sub_type")).alias("sub_type"), display_text(F.col("main_firm")).alias("main_firm"), display_text(F.col("main_date")).alias("main_date"), clean_document(F.col("document")).alias("document"))


def person_detail(a: Archive) -> DataFrame:
    """A live person with their name, acts, stakes by role and the years between which they are met."""
    mine = a.live_investor.select("investor_id", "person_id", "contract_id")
    acts = mine.join(a.live_contract.select("contract_id", F.when(F.col("registration_date").rlike(r"^[1-9]\d{3}-"), F.substring("registration_date", 1, 4)).alias("year")), "contract_id")
    met = acts.groupBy("person_id").agg(F.countDistinct("contract_id").alias("contracts"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    stakes = mine.join(a.live_investor_group.select("investor_id", "investment_id"), "investor_id").join(a.live_investment.select("investment_id", "type"), "investment_id")
    roles = stakes.groupBy("person_id").agg(F.count_if(F.col("type") == "gp").alias("as_gp"), F.count_if(F.col("type") == "lp").alias("as_lp"))
    out = a.live_person.join(met, "person_id", "left").join(roles, "person_id", "left")
    return out.select("person_id", display_name(F.col("first_name"), F.col("father_mother"), F.col("last_name")).alias("name"), yes_no(F.col("is_woman")).alias("woman"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("contracts", "as_gp", "as_lp")), "first_year", "last_year")


def partners(a: Archive) -> DataFrame:
    """(contract_id, kind, investor_id, investment_id, name, type, cash): the people of acts with their stakes (partner),
    people taken off (removed), and stakes that no live person holds (orphan)."""
    names = a.person.select("person_id", display_name(F.col("first_name"), F.col("father_mother"), F.col("last_name")).alias("name"))
    stake = a.live_investment.select("investment_id", "type", F.col("investment_cash").alias("cash"))
    held = a.live_investor_group.select("investor_id", "investment_id")
    columns = ["contract_id", "kind", "investor_id", "investment_id", "name", "type", "cash"]
    live = a.live_investor.select("investor_id", "person_id", "contract_id")
    mine = live.join(names, "person_id", "left").join(held.join(stake, "investment_id"), "investor_id", "left").withColumn("kind", F.lit("partner"))
    gone = a.investor.where("is_deleted = 1").select("investor_id", "person_id", "contract_id").join(names, "person_id", "left").select("*", F.lit("removed").alias("kind"), F.lit(None).cast("long").alias("investment_id"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("long").alias("cash"))
    owned = held.join(live.select("investor_id"), "investor_id", "left_semi").select("investment_id")
    loose = a.live_investment.select("investment_id", "contract_id", "type", F.col("investment_cash").alias("cash")).join(owned, "investment_id", "left_anti").select("*", F.lit("orphan").alias("kind"), F.lit(None).cast("long").alias("investor_id"), F.lit(None).cast("string").alias("name"))
    return mine.select(columns).unionByName(gone.select(columns)).unionByName(loose.select(columns))


def places(a: Archive) -> DataFrame:
    rows = a.live_contract_place.join(a.place, "place_id", "left")
    return rows.select("contract_id", "place_id", display_text(F.col("place_name")).alias("place"), display_text(F.col("address")).alias("address"))


def same_surname(a: Archive, last_name: str) -> DataFrame:
    """Live people whose family name is this but for accents, case and spaces."""
    key = lookup_key(F.lit(last_name))
    return a.live_person.where(lookup_key(F.col("last_name")) == key).select("person_id", "first_name", "last_name")


def contract_investments(a: Archive) -> DataFrame:
    """Live stakes of acts with the names of those who hold them."""
    names = a.live_person.select("person_id", display_name(F.col("first_name"), F.col("father_mother"), F.col("last_name")).alias("name"))
    holders = a.live_investor_group.select("investor_id", "investment_id").join(a.live_investor.select("investor_id", "person_id"), "investor_id").join(names, "person_id").groupBy("investment_id").agg(joined("name").alias("holders"))
    return a.live_investment.join(holders, "investment_id", "left").select("contract_id", "investment_id", "type", display_text(F.col("holders")).alias("holders"))


def contract_persons(a: Archive) -> DataFrame:
    return a.live_investor.select("contract_id", "person_id").distinct()


def context(a: Archive) -> DataFrame:
    """(contract_id, professions): each act's professions, once, in the order of the people who bring them."""
    first = a.live_investor.where("profession <> ''").groupBy("contract_id", "profession").agg(F.min("investor_id").alias("at"))
    listed = first.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("at", "profession"))).alias("x"))
    return listed.select("contract_id", F.array_join(F.col("x.profession"), ", ").alias("professions"))


def similar(a: Archive, folder: str, folio: str, each: int = 4, most: int = 6) -> DataFrame:
    """Acts and later acts at the same place of a register, `each` of a table and `most` in all, smallest id first."""
    here = (F.trim("folder") == folder) & (F.col("folio") == folio)
    rows = [df.where(here).select(F.lit(t).alias("db_table"), "contract_id").orderBy("contract_id").limit(each) for t, df in (("contract", a.live_contract), ("sub_contract", a.live_sub_contract))]
    return rows[0].unionByName(rows[1]).orderBy("db_table", "contract_id").limit(most)


def decided_pairs(log: DataFrame) -> DataFrame:
    """log(a, b, op, seq) of links between terms -> the unordered pairs (lo, hi) that are linked now."""
    pairs = log.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "op", "seq")
    return pairs.groupBy("lo", "hi").agg(F.max_by("op", "seq").alias("op")).where("op = 'add'").select("lo", "hi")


def applied(log: DataFrame) -> DataFrame:
    """Applied operations of each record in the order in which they hold; seq decides among equal times."""
    w = Window.partitionBy("pk").orderBy("created_at", "seq")
    return log.where("status = 'applied'").withColumn("nth", F.row_number().over(w))
