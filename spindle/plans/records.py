"""Queries of records, lists, folios, dates and decisions over the archive's views and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import quality, records, sequence
from ..sources.archive import Archive
from .registry import archive_query, query


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dash(x: str) -> str:
    return f"coalesce(nullif(trim(CAST({x} AS VARCHAR)), ''), '—')"


def _joined(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list(trim({x})) FILTER (WHERE trim({x}) <> ''))), '; ')"


_YES = "CASE {0} WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE '—' END"
_NAME = "coalesce(nullif(trim(regexp_replace(concat_ws(' ', nullif(first_name, ''), nullif(father_mother, ''), nullif(last_name, '')), ' +', ' ', 'g')), ''), '(unnamed)')"

# Records


@archive_query(f"SELECT c.contract_id, {_dash('c.firm_name')} AS firm, {_dash('''nullif(c.registration_date, '0000-00-00')''')} AS registered, {_dash('(SELECT min(currency) FROM currency k WHERE k.currency_id = c.currency_id)')} AS currency, {_dash('(SELECT min(activity) FROM economic_activity e WHERE e.ec_activity_id = c.economic_sector)')} AS activity, {_YES.format('c.ec_discretion')} AS discretion, {_dash('p.places')} AS places, coalesce(i.n, 0) AS investors, coalesce(s.n, 0) AS later_acts FROM contract c LEFT JOIN (SELECT contract_id, {_joined('place_name')} AS places FROM contract_place JOIN place USING (place_id) WHERE is_deleted = 0 GROUP BY 1) p USING (contract_id) LEFT JOIN (SELECT contract_id, count(*) AS n FROM investor WHERE is_deleted = 0 GROUP BY 1) i USING (contract_id) LEFT JOIN (SELECT main_contract_id AS contract_id, count(*) AS n FROM sub_contract WHERE is_deleted = 0 GROUP BY 1) s USING (contract_id) WHERE c.is_deleted = 0")
def contract_detail(a: Archive) -> DataFrame:
    """Acts as a reader sees them."""
    return records.contract_detail(a)


@archive_query(f"SELECT s.contract_id, s.main_contract_id, {_dash('s.sub_type')} AS sub_type, {_dash('c.firm_name')} AS main_firm, {_dash('c.registration_date')} AS main_date, replace(replace(coalesce(s.document, ''), '\\r\\n', chr(10)), '\\n', chr(10)) AS document FROM sub_contract s LEFT JOIN contract c ON c.contract_id = s.main_contract_id WHERE s.is_deleted = 0")
def sub_contract_detail(a: Archive) -> DataFrame:
    """Later acts with the act that they belong to."""
    return records.sub_contract_detail(a)


@archive_query(f"SELECT p.person_id, {_NAME} AS name, {_YES.format('p.is_woman')} AS woman, coalesce(m.n, 0) AS contracts, coalesce(r.gp, 0) AS as_gp, coalesce(r.lp, 0) AS as_lp, m.lo AS first_year, m.hi AS last_year FROM person p LEFT JOIN (SELECT person_id, count(DISTINCT contract_id) AS n, min(year) AS lo, max(year) AS hi FROM investor i JOIN (SELECT contract_id, CASE WHEN registration_date > '1' THEN substr(registration_date, 1, 4) END AS year FROM contract WHERE is_deleted = 0) c USING (contract_id) WHERE i.is_deleted = 0 GROUP BY 1) m USING (person_id) LEFT JOIN (SELECT person_id, count(*) FILTER (WHERE type = 'gp') AS gp, count(*) FILTER (WHERE type = 'lp') AS lp FROM (SELECT investor_id, person_id FROM investor WHERE is_deleted = 0) JOIN (SELECT investor_id, investment_id FROM investor_group WHERE is_deleted = 0) USING (investor_id) JOIN (SELECT investment_id, type FROM investment WHERE is_deleted = 0) USING (investment_id) GROUP BY 1) r USING (person_id) WHERE p.is_deleted = 0")
def person_detail(a: Archive) -> DataFrame:
    """People with their acts and roles."""
    return records.person_detail(a)


_STAKES = "(SELECT investment_id, type, investment_cash AS cash FROM investment WHERE is_deleted = 0)"
_HELD = "(SELECT investor_id, investment_id FROM investor_group WHERE is_deleted = 0)"


@archive_query(f"SELECT i.contract_id, 'partner' AS kind, i.investor_id, s.investment_id, n.name, s.type, s.cash FROM investor i LEFT JOIN (SELECT person_id, {_NAME} AS name FROM person) n USING (person_id) LEFT JOIN (SELECT * FROM {_HELD} JOIN {_STAKES} USING (investment_id)) s ON s.investor_id = i.investor_id WHERE i.is_deleted = 0 UNION ALL SELECT contract_id, 'removed', investor_id, NULL, name, NULL, NULL FROM investor LEFT JOIN (SELECT person_id, {_NAME} AS name FROM person) USING (person_id) WHERE is_deleted = 1 UNION ALL SELECT contract_id, 'orphan', NULL, investment_id, NULL, type, investment_cash FROM investment v WHERE is_deleted = 0 AND NOT EXISTS (SELECT 1 FROM {_HELD} h WHERE h.investment_id = v.investment_id AND h.investor_id IN (SELECT investor_id FROM investor WHERE is_deleted = 0))")
def act_partners(a: Archive) -> DataFrame:
    """People of acts with their stakes, those taken off, and stakes that nobody holds."""
    return records.partners(a)


@archive_query(f"SELECT c.contract_id, c.place_id, {_dash('p.place_name')} AS place, {_dash('c.address')} AS address FROM contract_place c LEFT JOIN place p USING (place_id) WHERE c.is_deleted = 0")
def act_places(a: Archive) -> DataFrame:
    """Places of acts with their addresses."""
    return records.places(a)


@archive_query("SELECT person_id, first_name, last_name FROM person WHERE is_deleted = 0 AND lower(trim(last_name)) = 'strozzi'")
def same_surname(a: Archive) -> DataFrame:
    """People of one family name."""
    return records.same_surname(a, " STROZZÌ")


@archive_query(f"SELECT v.contract_id, v.investment_id, v.type, {_dash('h.holders')} AS holders FROM investment v LEFT JOIN (SELECT investment_id, {_joined('name')} AS holders FROM {_HELD} JOIN (SELECT investor_id, person_id FROM investor WHERE is_deleted = 0) USING (investor_id) JOIN (SELECT person_id, {_NAME} AS name FROM person WHERE is_deleted = 0) USING (person_id) GROUP BY 1) h USING (investment_id) WHERE v.is_deleted = 0")
def act_investments(a: Archive) -> DataFrame:
    """Stakes of acts with those who hold them."""
    return records.contract_investments(a)


@archive_query("SELECT contract_id, person_id FROM investor WHERE is_deleted = 0 GROUP BY ALL")
def act_persons(a: Archive) -> DataFrame:
    """People of acts, once each."""
    return records.contract_persons(a)


@archive_query("SELECT contract_id, string_agg(profession, ', ' ORDER BY since, profession) AS professions FROM (SELECT contract_id, profession, min(investor_id) AS since FROM investor WHERE is_deleted = 0 AND profession <> '' GROUP BY 1, 2) GROUP BY 1")
def act_context(a: Archive) -> DataFrame:
    """Distinct professions of acts, in order."""
    return records.context(a)


# Lists


@archive_query("(SELECT 'contract' AS db_table, contract_id FROM contract WHERE is_deleted = 0 AND trim(folder) = '10802' AND folio = '3r' ORDER BY 2 LIMIT 4) UNION ALL (SELECT 'sub_contract', contract_id FROM sub_contract WHERE is_deleted = 0 AND folder = '10802' AND folio = '3r' ORDER BY 2 LIMIT 4) ORDER BY 1, 2 LIMIT 6")
def similar_acts(a: Archive) -> DataFrame:
    """Acts at the same place of a register."""
    return records.similar(a, "10802", "3r")


@archive_query("WITH u AS (SELECT place_of_residence AS k FROM investor UNION ALL SELECT place_of_origin FROM investor UNION ALL SELECT place_id FROM contract_place) SELECT place_name, count(*) AS used FROM u JOIN place ON place_id = k GROUP BY 1 ORDER BY 2 DESC, lower(trim(place_name)) LIMIT 12")
def top_usage(a: Archive) -> DataFrame:
    """The twelve places that are used most."""
    keys = [a.investor.select(F.col(c).alias("place_id")) for c in ("place_of_residence", "place_of_origin")]
    used = keys[0].unionByName(keys[1]).unionByName(a.contract_place.select("place_id")).groupBy("place_id").agg(F.count("*").alias("n"))
    rows = used.join(a.place, "place_id").groupBy("place_name").agg(F.sum("n").alias("used"))
    return rows.orderBy(F.desc("used"), tx.lookup_key(F.col("place_name"))).limit(12)


@archive_query("SELECT contract_id FROM contract WHERE is_deleted = 0 AND trim(folder) = '10805' AND lower(concat_ws(' ', archive, series, folder, folio, registration_date, firm_name, document)) LIKE '%firm 1%' ORDER BY 1 LIMIT 50")
def case_list(a: Archive) -> DataFrame:
    """Cases of one register whose seven fields together hold a text."""
    fields = F.lower(F.concat_ws(" ", "archive", "series", "folder", "folio", "registration_date", "firm_name", "document"))
    return a.live_contract.where((F.trim("folder") == "10805") & F.contains(fields, F.lit("firm 1"))).select("contract_id").orderBy("contract_id").limit(50)


@archive_query("SELECT term, CAST(sum(n) AS BIGINT) AS mentions FROM (SELECT 'scudi' AS term, count(*) FILTER (WHERE document ILIKE '%scudi%') AS n FROM contract UNION ALL SELECT 'urgent', count(*) FILTER (WHERE document ILIKE '%urgent%') FROM contract UNION ALL SELECT 'scudi', count(*) FILTER (WHERE document ILIKE '%scudi%') FROM sub_contract UNION ALL SELECT 'urgent', count(*) FILTER (WHERE document ILIKE '%urgent%') FROM sub_contract) GROUP BY 1")
def narrative_mentions(a: Archive) -> DataFrame:
    """Acts whose text names a term; one pass for all terms."""
    docs = a.contract.select("document").unionByName(a.sub_contract.select("document"))
    terms = ("scudi", "urgent")
    n = docs.agg(*[F.count_if(F.col("document").ilike(f"%{t}%")).alias(t) for t in terms])
    return n.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("mentions")) for t in terms])).alias("x")).select("x.*")


@archive_query("SELECT s.contract_id AS later_id, c.contract_id, c.firm_name FROM sub_contract s JOIN contract c ON CAST(c.contract_id AS VARCHAR) = trim(CAST(s.main_contract_id AS VARCHAR)) WHERE s.is_deleted = 0")
def joined_as_text(a: Archive) -> DataFrame:
    """Rows whose key is another's as text (table:id), split and cast back, so that the join is of numbers."""
    keyed = a.live_sub_contract.select(F.col("contract_id").alias("later_id"), F.concat(F.lit("contract:"), F.col("main_contract_id")).alias("db_row_id"))
    keyed = keyed.where(F.split_part("db_row_id", F.lit(":"), F.lit(1)) == "contract").withColumn("contract_id", F.split_part("db_row_id", F.lit(":"), F.lit(2)).cast("long"))
    return keyed.join(a.contract.select("contract_id", "firm_name"), "contract_id").select("later_id", "contract_id", "firm_name")


# Folios and dates


_N = "(1 + o_orderkey % 190)"


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN {_N} || 'r' WHEN 1 THEN {_N} || 'v' WHEN 2 THEN {_N} || 'v' WHEN 3 THEN {_N} || 'r' WHEN 4 THEN {_N} || 'bisr' WHEN 5 THEN 'n.n' ELSE {_N} || 'r' END AS start, CASE o_orderkey % 7 WHEN 0 THEN {_N} || 'r' WHEN 1 THEN ({_N} + 1) || 'r' WHEN 2 THEN {_N} || 'v' WHEN 3 THEN {_N} || 'v' WHEN 4 THEN {_N} || 'bisr' WHEN 5 THEN 'n.n' ELSE {_N} || 'v' END AS \"end\" FROM orders")
def db_folios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folios as rows give them, with notes, ranges and shorthand, as start and end."""
    k, n = F.col("o_orderkey"), (1 + F.col("o_orderkey") % 190).cast("string")
    forms = [F.concat(n, F.lit("r[ORIG.93r]")), F.concat(n, F.lit("v-"), (1 + F.col("o_orderkey") % 190 + 1).cast("string"), F.lit("r/117v")), F.concat(n, F.lit(" v = 774")), F.concat(n, F.lit("rv")), F.concat(n, F.lit("bisr")), F.lit("n.n"), F.concat(n, F.lit("r-v"))]
    folio = F.array(*forms)[(k % 7).cast("int")]
    return _read(spark, sf_dir, "orders").select(k.alias("id"), tx.db_folio(folio).alias("f")).select("id", "f.start", "f.end")


@archive_query("WITH x AS (SELECT s.contract_id AS id, 2 * CAST(regexp_extract(c.folio, '[0-9]+') AS INTEGER) + CASE WHEN c.folio LIKE '%v' THEN 1 ELSE 0 END AS lo, CAST(regexp_extract(c.folio, '[0-9]+') AS INTEGER) AS n, CAST(regexp_extract(s.folio, '[0-9]+') AS INTEGER) AS m FROM sub_contract s JOIN contract c ON c.contract_id = s.main_contract_id), y AS (SELECT id, lo, 2 * (n + 2) + 1 AS hi, n, n + 2 AS n2, 2 * m AS low, 2 * m + 2 AS high, m, m + 1 AS m2 FROM x) SELECT id, CASE WHEN lo = low AND hi = high THEN 'exact' WHEN (lo <= low AND high <= hi) OR (low <= lo AND hi <= high) THEN 'within' WHEN lo <= high AND low <= hi THEN 'overlap' WHEN greatest(m - n2, n - m2) = 1 THEN 'off_by_one' ELSE 'different' END AS relation FROM y")
def folio_relations(a: Archive) -> DataFrame:
    """How the folios of acts (three leaves) stand to those of their later acts (a leaf's end)."""
    acts = a.contract.select(F.col("contract_id").alias("main_contract_id"), F.col("folio").alias("start"), F.concat(F.regexp_extract("folio", r"\d+", 0).cast("int") + 2, F.lit("v")).alias("end"))
    rows = a.sub_contract.select("contract_id", "main_contract_id", F.col("folio").alias("other"), F.concat(F.regexp_extract("folio", r"\d+", 0).cast("int") + 1, F.lit("r")).alias("other_end")).join(acts, "main_contract_id")
    return rows.select(F.col("contract_id").alias("id"), tx.folio_relation(F.col("start"), F.col("end"), F.col("other"), F.col("other_end")).alias("relation"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN (300 + CAST(substr(CAST(year(o_orderdate) - 300 AS VARCHAR), 1, 2) || lpad(CAST((year(o_orderdate) - 299) % 100 AS VARCHAR), 2, '0') AS INTEGER)) || strftime(o_orderdate, '-%m-%d') WHEN strftime(o_orderdate, '%m-%d') >= '03-25' THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders WHERE o_orderdate IS NOT NULL AND strftime(o_orderdate, '%m-%d') <> '02-29'")
def modern_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Florentine dates, some with a second year, as modern ones; null where two years are possible."""
    o = _read(spark, sf_dir, "orders").where("o_orderdate is not null and date_format(o_orderdate, 'MM-dd') <> '02-29'")
    month, year = F.array(*[F.lit(m) for m in list(tx.MONTHS)[:12]])[F.month("o_orderdate") - 1], F.year("o_orderdate") - 300
    suffix = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))).otherwise("")
    iso = tx.modern_date(F.concat_ws(" ", F.lit("addì"), F.dayofmonth("o_orderdate").cast("string"), month, F.concat(year.cast("string"), suffix)))
    return o.select(F.col("o_orderkey").alias("id"), F.concat((F.substring(iso, 1, 4).cast("int") + 300).cast("string"), F.substring(iso, 5, 6)).alias("iso"))


@archive_query("SELECT s.contract_id AS id, strftime(CAST(s.registration_date AS DATE), '%-d %b %Y') AS shown, abs(date_diff('day', CAST(c.registration_date AS DATE), CAST(s.registration_date AS DATE))) AS gap FROM (SELECT * FROM sub_contract WHERE registration_date <> '0000-00-00') s JOIN (SELECT * FROM contract WHERE registration_date > '1') c ON c.contract_id = s.main_contract_id")
def day_gaps(a: Archive) -> DataFrame:
    """days between an act and its later acts, and the date as it is shown."""
    acts = a.contract.where("registration_date > '1'").select(F.col("contract_id").alias("main_contract_id"), F.to_date("registration_date").alias("day"))
    rows = a.sub_contract.where("registration_date <> '0000-00-00'").join(acts, "main_contract_id")
    return rows.select(F.col("contract_id").alias("id"), tx.shown_date(F.col("registration_date")).alias("shown"), F.abs(F.datediff(F.to_date("registration_date"), "day")).cast("long").alias("gap"))


# Order within a register (conversations stand for registers, turns for paragraphs)


@query("SELECT conv_id, coalesce(min(turn) FILTER (WHERE length(text) > 200), 25) AS boundary FROM conversations GROUP BY 1")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a register's front matter ends: its first heading, else paragraph 25."""
    c = _read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.coalesce(F.min(F.when(F.length("text") > 200, F.col("turn"))), F.lit(25)).alias("boundary"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN length(text) > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS body FROM conversations) WHERE body = 0")
def head_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs before the first of the body."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _read(spark, sf_dir, "conversations").withColumn("body", F.max(F.when(F.length("text") > 200, 1).otherwise(0)).over(w))
    return c.where("body = 0").select("conv_id", "turn")


@query("SELECT c.conv_id, c.turn FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE length(text) > 60 GROUP BY 1) l ON l.conv_id = c.conv_id AND c.turn <= l.last")
def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs without the blank ones at the end (short ones stand for blank)."""
    c = _read(spark, sf_dir, "conversations")
    last = c.where(F.length("text") > 60).groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.join(last, "conv_id").where("turn <= last").select("conv_id", "turn")


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations")
def previous_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row before each that may be linked."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("previous"))


# Candidates, links and decisions (events stand for them)


@query("SELECT user_id, event_type, arg_max(event_id, (value, -event_id)) AS event_id FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def deduped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each key the candidate of highest priority, the first on ties."""
    e = _read(spark, sf_dir, "events").where("value is not null").select("user_id", "event_type", "event_id", "value")
    return sequence.best(e, ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT event_type AS bucket, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM events UNION ALL SELECT 'high', count(*) FILTER (WHERE value >= 50) FROM events")
def bucket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of overlapping buckets from one pass."""
    tests = {t: F.col("event_type") == t for t in ("signup", "purchase", "error", "view", "click")} | {"all": F.lit(True), "high": F.col("value") >= 50}
    n = _read(spark, sf_dir, "events").agg(*[F.count_if(c).alias(t) for t, c in tests.items()])
    return n.select(F.explode(F.array(*[F.struct(F.lit(t).alias("bucket"), F.col(t).alias("n")) for t in tests])).alias("x")).select("x.*")


@archive_query("SELECT investment_id, count(*) AS links, string_agg(CAST(investor_id AS VARCHAR), ',' ORDER BY investor_id) AS investors FROM investor_group WHERE is_deleted = 0 GROUP BY 1 HAVING count(*) > 1")
def duplicate_links(a: Archive) -> DataFrame:
    """Rows that several entries link to, with these."""
    rows = a.live_investor_group.groupBy("investment_id").agg(F.count("*").alias("links"), F.array_sort(F.collect_list("investor_id")).alias("x"))
    return rows.where("links > 1").select("investment_id", "links", F.array_join(F.col("x").cast("array<string>"), ",").alias("investors"))


@query("SELECT user_id, bool_or(event_type = 'error') AS needs_review, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, min(event_id) AS first_seen FROM events GROUP BY 1")
def grouped_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one scan with its flag and distinct kinds."""
    e = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("needs_review"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.min("event_id").alias("first_seen"))
    return e


@query("SELECT user_id AS family, min(value) AS confidence, count(DISTINCT event_type) AS members FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2")
def family_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family is as sure as its least sure member; families have two at least."""
    e = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("family")).agg(F.min("value").alias("confidence"), F.countDistinct("event_type").alias("members"))
    return e.where("members >= 2")


@query("SELECT CASE WHEN value IS NULL THEN 'unknown' WHEN value / 100 >= 0.75 THEN 'strong' WHEN value / 100 >= 0.5 THEN 'partial' ELSE 'weak' END AS band, count(*) AS n FROM events GROUP BY 1")
def strength_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by the strength of their match."""
    return _read(spark, sf_dir, "events").groupBy(tx.strength_band(F.col("value") / 100).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, value + CASE WHEN event_type = 'error' THEN 50 ELSE 0 END AS score, row_number() OVER (PARTITION BY user_id ORDER BY value + CASE WHEN event_type = 'error' THEN 50 ELSE 0 END DESC, event_id) AS rank FROM events WHERE value >= 20 QUALIFY rank <= 10")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with those that a person confirmed first, ranked."""
    e = _read(spark, sf_dir, "events").where("value >= 20").withColumn("score", F.col("value") + F.when(F.col("event_type") == "error", 50).otherwise(0))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "event_id")).cast("long")
    return e.withColumn("rank", rank).where("rank <= 10").select("event_id", "user_id", "score", "rank")


@query("SELECT least(user_id, event_id % 100) AS lo, greatest(user_id, event_id % 100) AS hi FROM events GROUP BY 1, 2 HAVING arg_max(event_type, event_id) <> 'error'")
def decided_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs whose last decision links them."""
    op = F.when(F.col("event_type") == "error", "revoke").otherwise("add")
    return records.decided_pairs(_read(spark, sf_dir, "events").select(F.col("user_id").alias("a"), (F.col("event_id") % 100).alias("b"), op.alias("op"), F.col("event_id").alias("seq")))


@query("SELECT CAST(user_id AS VARCHAR) AS pk, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type IN ('purchase', 'view')")
def applied_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied operations in the order in which they hold."""
    e = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("pk"), F.col("event_id").alias("seq"), F.col("ts").alias("created_at"), F.when(F.col("event_type").isin("purchase", "view"), "applied").otherwise("proposed").alias("status"))
    return records.applied(e).select("pk", "seq", F.col("nth").cast("long").alias("nth"))


@archive_query("SELECT contract_id AS pk FROM contract WHERE is_deleted = 0 AND length(document) > 0 AND contract_id % 2 = 1 AND contract_id NOT IN (SELECT contract_id FROM investor WHERE is_deleted = 0)")
def dismissed_flags(a: Archive) -> DataFrame:
    """Flags without those that were dismissed (those of even acts)."""
    flags = quality.no_partners(a)
    gone = flags.where("pk % 2 = 0").select("flag_key")
    return flags.join(gone, "flag_key", "left_anti").select("pk")


@query("WITH l AS (SELECT user_id, event_type, CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'rejected' ELSE 'proposed' END AS status FROM events) SELECT user_id, CAST(min(CASE status WHEN 'confirmed' THEN 0 WHEN 'proposed' THEN 1 ELSE 2 END) AS INTEGER) AS rank, count(*) FILTER (WHERE status = 'confirmed') AS confirmed FROM l GROUP BY 1")
def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best status of each row's links."""
    status = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 2).otherwise(1)
    return _read(spark, sf_dir, "events").groupBy("user_id").agg(F.min(status).alias("rank"), F.count_if(F.col("event_type") == "purchase").alias("confirmed"))
