"""The library of named analyses over the archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import blank_date, decade, ec_true, year
from ..sources.archive import Archive
from .registry import archive_query

LIVE = "is_deleted = 0"
DATED = "registration_date IS NOT NULL AND registration_date NOT IN ('', '0000-00-00', 'NULL')"


def _pct(flag) -> F.Column:
    return F.round(F.lit(100.0).cast("double") * F.count_if(flag) / F.count("*"), 1)


@archive_query("SELECT 'contracts' AS item, count(*) AS n FROM contract WHERE is_deleted = 0 UNION ALL SELECT 'later acts', count(*) FROM sub_contract WHERE is_deleted = 0 UNION ALL SELECT 'people', count(*) FROM person WHERE is_deleted = 0 UNION ALL SELECT 'places', count(*) FROM place UNION ALL SELECT 'currencies', count(*) FROM currency")
def corpus_totals(a: Archive) -> DataFrame:
    """Q01: one count for each kind of record."""
    parts = [("contracts", a.live_contract), ("later acts", a.live_sub_contract), ("people", a.live_person), ("places", a.place), ("currencies", a.currency)]
    out = [df.agg(F.count("*").alias("n")).select(F.lit(item).alias("item"), "n") for item, df in parts]
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


@archive_query(f"SELECT CAST(substr(registration_date, 1, 4) AS INTEGER) AS year, count(*) AS contracts FROM contract WHERE {LIVE} AND {DATED} GROUP BY 1")
def contracts_per_year(a: Archive) -> DataFrame:
    """Q02: dated acts by year; placeholder dates are none."""
    return a.live_contract.where(~blank_date("registration_date")).groupBy(year("registration_date").alias("year")).agg(F.count("*").alias("contracts"))


@archive_query("SELECT any_value(cu.currency) AS currency, count(*) AS contracts FROM contract c JOIN currency cu ON cu.currency_id = c.currency_id WHERE c.is_deleted = 0 GROUP BY cu.currency_id")
def currency_frequency(a: Archive) -> DataFrame:
    """Q03: grouped by id; two currencies may have one name."""
    counts = a.live_contract.groupBy("currency_id").agg(F.count("*").alias("contracts"))
    return counts.join(a.currency, "currency_id").select("currency", "contracts")


@archive_query("SELECT any_value(cu.currency) AS currency, count(*) AS contracts, round(sum(CAST(c.total AS DOUBLE))) AS total_capital FROM contract c JOIN currency cu ON cu.currency_id = c.currency_id WHERE c.is_deleted = 0 AND regexp_matches(c.total, '^[0-9]') GROUP BY cu.currency_id")
def currency_totals(a: Archive) -> DataFrame:
    """Q04: sums of the totals that begin with a digit."""
    rows = a.live_contract.where(F.col("total").rlike("^[0-9]"))
    sums = rows.groupBy("currency_id").agg(F.count("*").alias("contracts"), F.round(F.sum(F.expr("try_cast(total AS DOUBLE)"))).alias("total_capital"))
    return sums.join(a.currency, "currency_id").select("currency", "contracts", "total_capital")


@archive_query("SELECT any_value(p.place_name) AS place_name, count(*) AS contracts FROM contract_place cp JOIN place p ON p.place_id = cp.place_id WHERE cp.is_deleted = 0 GROUP BY cp.place_id")
def location_frequency(a: Archive) -> DataFrame:
    """Q05: live links by place; whether the act itself is live does not matter."""
    return a.live_contract_place.groupBy("place_id").agg(F.count("*").alias("contracts")).join(a.place, "place_id").select("place_name", "contracts")


@archive_query(f"SELECT contract_id, count(*) AS investors FROM investor WHERE {LIVE} GROUP BY contract_id")
def investors_per_contract(a: Archive) -> DataFrame:
    """Q06."""
    return a.live_investor.groupBy("contract_id").agg(F.count("*").alias("investors"))


@archive_query(f"SELECT main_contract_id AS contract_id, count(*) AS later_acts FROM sub_contract WHERE {LIVE} GROUP BY 1")
def acts_per_contract(a: Archive) -> DataFrame:
    """Q07."""
    return a.live_sub_contract.groupBy(F.col("main_contract_id").alias("contract_id")).agg(F.count("*").alias("later_acts"))


@archive_query(f"SELECT type AS role, count(*) AS investments FROM investment WHERE {LIVE} AND type IN ('gp', 'lp') GROUP BY 1")
def investments_by_role(a: Archive) -> DataFrame:
    """Q08."""
    return a.live_investment.where(F.col("type").isin("gp", "lp")).groupBy(F.col("type").alias("role")).agg(F.count("*").alias("investments"))


@archive_query("SELECT DISTINCT c.contract_id, substr(c.registration_date, 1, 4) AS year, p.first_name, p.last_name FROM person p JOIN investor i ON i.person_id = p.person_id JOIN contract c ON c.contract_id = i.contract_id WHERE p.is_woman = 1 AND i.is_deleted = 0 AND c.is_deleted = 0")
def women_investors(a: Archive) -> DataFrame:
    """Q09."""
    women = a.person.where("is_woman = 1").select("person_id", "first_name", "last_name")
    acts = a.live_contract.select("contract_id", F.substring("registration_date", 1, 4).alias("year"))
    return a.live_investor.join(women, "person_id").join(acts, "contract_id").select("contract_id", "year", "first_name", "last_name").distinct()


@archive_query(f"SELECT contract_id, registration_date, firm_name FROM contract WHERE {LIVE} AND ec_discretion = 1")
def ec_discretion_yes(a: Archive) -> DataFrame:
    """Q10."""
    return a.live_contract.where(ec_true("ec_discretion")).select("contract_id", "registration_date", "firm_name")


def _lacking(a: Archive, other: DataFrame) -> DataFrame:
    return a.live_contract.join(other.select("contract_id"), "contract_id", "left_anti").select("contract_id", "registration_date", "firm_name")


@archive_query("SELECT c.contract_id, c.registration_date, c.firm_name FROM contract c LEFT JOIN contract_place cp ON cp.contract_id = c.contract_id AND cp.is_deleted = 0 WHERE c.is_deleted = 0 AND cp.contract_id IS NULL")
def no_place(a: Archive) -> DataFrame:
    """Q11."""
    return _lacking(a, a.live_contract_place)


@archive_query("SELECT c.contract_id, c.registration_date, c.firm_name FROM contract c LEFT JOIN investor i ON i.contract_id = c.contract_id AND i.is_deleted = 0 WHERE c.is_deleted = 0 AND i.contract_id IS NULL")
def no_investors(a: Archive) -> DataFrame:
    """Q12."""
    return _lacking(a, a.live_investor)


@archive_query(f"SELECT contract_id, registration_date, firm_name FROM contract WHERE {LIVE} AND (economic_sector = 0 OR economic_sector IS NULL)")
def no_economic_activity(a: Archive) -> DataFrame:
    """Q13."""
    return a.live_contract.where("economic_sector = 0 or economic_sector is null").select("contract_id", "registration_date", "firm_name")


_JEWISH = "(is_jewish = 1 OR jewish_db = 1)"
_ACT = "SELECT substr(registration_date, 1, 4) AS year, contract_id, firm_name FROM contract WHERE is_deleted = 0"


def _by_flag(a: Archive, mixed: bool) -> DataFrame:
    # one aggregate tells which acts have investors of either kind
    flag = F.expr(_JEWISH)
    kinds = a.live_investor.groupBy("contract_id").agg(F.bool_or(flag).alias("has"), F.bool_or(~flag).alias("lacks")).where("has").where(F.col("lacks") == mixed)
    return a.live_contract.join(kinds, "contract_id", "left_semi").select(F.substring("registration_date", 1, 4).alias("year"), "contract_id", "firm_name")


@archive_query(f"{_ACT} AND contract_id IN (SELECT contract_id FROM investor WHERE is_deleted = 0 AND {_JEWISH}) AND contract_id NOT IN (SELECT contract_id FROM investor WHERE is_deleted = 0 AND NOT {_JEWISH})")
def jewish_all(a: Archive) -> DataFrame:
    """Q14: acts all of whose investors have the flag."""
    return _by_flag(a, False)


@archive_query(f"{_ACT} AND contract_id IN (SELECT contract_id FROM investor WHERE is_deleted = 0 AND {_JEWISH}) AND contract_id IN (SELECT contract_id FROM investor WHERE is_deleted = 0 AND NOT {_JEWISH})")
def jewish_mixed(a: Archive) -> DataFrame:
    """Q15: acts with investors of both kinds."""
    return _by_flag(a, True)


@archive_query("WITH n AS (SELECT type, contract_id, count(*) AS k FROM investment WHERE is_deleted = 0 AND type IN ('gp', 'lp') GROUP BY 1, 2) SELECT type AS role, min(k) AS min, round(avg(k), 2) AS avg, max(k) AS max FROM n GROUP BY 1")
def gp_lp_per_contract(a: Archive) -> DataFrame:
    """Q16: least, mean and most investments of an act, by role."""
    per = a.live_investment.where(F.col("type").isin("gp", "lp")).groupBy("type", "contract_id").agg(F.count("*").alias("k"))
    return per.groupBy(F.col("type").alias("role")).agg(F.min("k").alias("min"), F.round(F.avg("k"), 2).alias("avg"), F.max("k").alias("max"))


_SAME = "((a.last_name <> '' AND a.last_name = b.last_name) OR (a.father_mother <> '' AND a.father_mother = b.father_mother) OR (a.grandfather <> '' AND a.grandfather = b.grandfather))"


@archive_query(f"WITH x AS (SELECT i.contract_id, i.investor_id, p.last_name, p.father_mother, p.grandfather, p.first_name FROM investor i JOIN person p ON p.person_id = i.person_id WHERE i.is_deleted = 0) SELECT DISTINCT a.contract_id, a.last_name, a.father_mother, a.grandfather, a.first_name FROM x a JOIN x b ON a.contract_id = b.contract_id AND a.investor_id <> b.investor_id AND {_SAME}")
def relatives_in_contract(a: Archive) -> DataFrame:
    """Q17: investors of one act who share a family name, parent or grandparent: each of the three is counted in a window
    of its act, so that a large act is not joined with itself."""
    from pyspark.sql import Window

    x = a.live_investor.join(a.person, "person_id").select("contract_id", "investor_id", "last_name", "father_mother", "grandfather", "first_name")
    shared = F.lit(False)
    for c in ("last_name", "father_mother", "grandfather"):
        w = Window.partitionBy("contract_id", c)
        again = F.min("investor_id").over(w) != F.max("investor_id").over(w)
        x = x.withColumn(f"shared_{c}", (F.coalesce(F.col(c), F.lit("")) != "") & again)
        shared = shared | F.col(f"shared_{c}")
    return x.where(shared).select("contract_id", "last_name", "father_mother", "grandfather", "first_name").distinct()


@archive_query("SELECT round(100.0 * sum(CASE WHEN via_proxy = 1 THEN 1 ELSE 0 END) / count(*), 1) AS pct_via_proxy, count(*) AS total_investors FROM investor WHERE is_deleted = 0")
def pct_via_proxy(a: Archive) -> DataFrame:
    """Q18."""
    return a.live_investor.agg(_pct(F.col("via_proxy") == 1).alias("pct_via_proxy"), F.count("*").alias("total_investors"))


def _over_time_sql(flag: str, name: str) -> str:
    return f"SELECT CAST(substr(c.registration_date, 1, 3) || '0' AS INTEGER) AS decade, count(*) AS investors, round(100.0 * sum(CASE WHEN {flag} THEN 1 ELSE 0 END) / count(*), 1) AS {name} FROM investor i JOIN contract c ON c.contract_id = i.contract_id WHERE i.is_deleted = 0 AND c.is_deleted = 0 AND {DATED} GROUP BY 1 HAVING count(*) >= 30"


def _over_time(a: Archive, flag: str, name: str) -> DataFrame:
    acts = a.live_contract.where(~blank_date("registration_date")).select("contract_id", decade("registration_date").alias("decade"))
    rows = a.live_investor.join(acts, "contract_id")
    return rows.groupBy("decade").agg(F.count("*").alias("investors"), _pct(F.expr(flag)).alias(name)).where("investors >= 30")


@archive_query(_over_time_sql("i.via_proxy = 1", "pct_via_proxy"))
def via_proxy_over_time(a: Archive) -> DataFrame:
    """Q19."""
    return _over_time(a, "via_proxy = 1", "pct_via_proxy")


@archive_query(_over_time_sql("i.is_jewish = 1 OR i.jewish_db = 1", "pct_jewish"))
def jewish_over_time(a: Archive) -> DataFrame:
    """Q20."""
    return _over_time(a, _JEWISH, "pct_jewish")


@archive_query(_over_time_sql("i.is_joint = 1", "pct_joint"))
def joint_over_time(a: Archive) -> DataFrame:
    """Q21."""
    return _over_time(a, "is_joint = 1", "pct_joint")


_FUNDING = "CASE WHEN cash > 0 AND kind > 0 THEN 'cash and non-cash' WHEN cash > 0 THEN 'cash only' WHEN kind > 0 THEN 'non-cash only' ELSE 'not stated' END"


@archive_query(f"WITH x AS (SELECT contract_id, sum(coalesce(investment_cash, 0)) AS cash, sum(CASE WHEN coalesce(investment_non_cash, '') <> '' THEN 1 ELSE 0 END) AS kind FROM investment WHERE is_deleted = 0 GROUP BY 1) SELECT {_FUNDING} AS funding, count(*) AS contracts FROM x GROUP BY 1")
def funding_composition(a: Archive) -> DataFrame:
    """Q22: here alone an unspecified amount counts as none."""
    per = a.live_investment.groupBy("contract_id").agg(F.sum(F.coalesce("investment_cash", F.lit(0))).alias("cash"), F.count_if(F.coalesce("investment_non_cash", F.lit("")) != "").alias("kind"))
    return per.groupBy(F.expr(_FUNDING).alias("funding")).agg(F.count("*").alias("contracts"))


@archive_query(f"SELECT duration_months AS initial_term_months, count(*) AS contracts FROM contract WHERE {LIVE} AND duration_months > 0 GROUP BY 1 ORDER BY contracts DESC, 1 LIMIT 15")
def initial_term(a: Archive) -> DataFrame:
    """Q23: the fifteen most frequent terms; ties by the shorter term."""
    return a.live_contract.where("duration_months > 0").groupBy(F.col("duration_months").alias("initial_term_months")).agg(F.count("*").alias("contracts")).orderBy(F.desc("contracts"), "initial_term_months").limit(15)


@archive_query(f"SELECT sub_type AS act_type, count(*) AS acts FROM sub_contract WHERE {LIVE} AND sub_type NOT IN ('', '0') GROUP BY 1")
def later_acts_by_type(a: Archive) -> DataFrame:
    """Q24: a null type is left out too."""
    return a.live_sub_contract.where(~F.col("sub_type").isin("", "0")).groupBy(F.col("sub_type").alias("act_type")).agg(F.count("*").alias("acts"))
