"""Browse, search, vocabulary, sequence and log queries over the archive's views and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.predicates import blank_date, decade, has_key
from ..operators import builder, oplog, search, sequence
from ..sources.archive import Archive
from .registry import archive_query, query

DATED = "registration_date IS NOT NULL AND registration_date NOT IN ('', '0000-00-00', 'NULL')"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Facets, usage, lists


@archive_query(f"SELECT 'register' AS facet, trim(folder) AS value, count(*) AS n FROM contract WHERE is_deleted = 0 GROUP BY 2 UNION ALL SELECT 'decade', substr(registration_date, 1, 3) || '0', count(*) FROM contract WHERE is_deleted = 0 AND {DATED} GROUP BY 2")
def facets(a: Archive) -> DataFrame:
    """Registers and decades of live acts."""
    acts = a.live_contract
    registers = acts.groupBy(F.trim("folder").alias("value")).agg(F.count("*").alias("n")).select(F.lit("register").alias("facet"), "value", "n")
    decades = acts.where(~blank_date("registration_date")).groupBy(decade("registration_date").cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit("decade").alias("facet"), "value", "n")
    return registers.unionByName(decades)


@archive_query("WITH u AS (SELECT place_of_residence AS k FROM investor UNION ALL SELECT place_of_origin FROM investor UNION ALL SELECT place_id FROM contract_place) SELECT p.place_id, p.place_name, count(u.k) AS used FROM place p LEFT JOIN u ON u.k = p.place_id AND u.k <> 0 GROUP BY 1, 2")
def usage_counts(a: Archive) -> DataFrame:
    """Uses of each place by all columns that point to places."""
    keys = [a.investor.select(F.col("place_of_residence").alias("place_id")), a.investor.select(F.col("place_of_origin").alias("place_id")), a.contract_place.select("place_id")]
    used = keys[0].unionByName(keys[1]).unionByName(keys[2]).where(has_key("place_id")).groupBy("place_id").agg(F.count("*").alias("used"))
    return a.place.join(used, "place_id", "left").select("place_id", "place_name", F.coalesce("used", F.lit(0)).alias("used"))


@archive_query("SELECT place_id, place_name, CASE WHEN lower(trim(place_name)) = 'nation_1' THEN 0 WHEN lower(trim(place_name)) LIKE 'nation_1%' THEN 1 ELSE 2 END AS rank FROM place WHERE place_name ILIKE '%nation_1%' ORDER BY 3, 2 LIMIT 8")
def typeahead(a: Archive) -> DataFrame:
    """Exact, prefix and inner matches of a term, best eight."""
    name = F.lower(F.trim("place_name"))
    rank = F.when(name == "nation_1", 0).when(name.startswith("nation_1"), 1).otherwise(2)
    return a.place.where(F.col("place_name").ilike("%nation_1%")).select("place_id", "place_name", rank.alias("rank")).orderBy("rank", "place_name").limit(8)


@archive_query("SELECT contract_id, firm_name, registration_date FROM contract WHERE is_deleted = 0 AND (firm_name ILIKE '%firm 12%' OR document ILIKE '%firm 12%' OR CAST(contract_id AS VARCHAR) ILIKE '%firm 12%') AND substr(registration_date, 1, 4) BETWEEN '1993' AND '1996' ORDER BY CASE WHEN registration_date IN ('', '0000-00-00') OR registration_date IS NULL THEN 1 ELSE 0 END, registration_date, contract_id LIMIT 25 OFFSET 10")
def paged_search(a: Archive) -> DataFrame:
    """A page of a free-text search, placeholders last."""
    q = "%firm 12%"
    hit = F.col("firm_name").ilike(q) | F.col("document").ilike(q) | F.col("contract_id").cast("string").ilike(q)
    rows = a.live_contract.where(hit & F.substring("registration_date", 1, 4).between("1993", "1996"))
    return rows.orderBy(F.when(blank_date("registration_date"), 1).otherwise(0), "registration_date", "contract_id").select("contract_id", "firm_name", "registration_date").offset(10).limit(25)


@archive_query("WITH n AS (SELECT trim(folder) AS register, series, count(*) AS n FROM contract GROUP BY 1, 2) SELECT register, max_by(series, n) AS series, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1")
def registers(a: Archive) -> DataFrame:
    """Registers with the series most of their acts name."""
    return sequence.majority(a.contract.select(F.trim("folder").alias("register"), "series"), ["register"], "series")


@archive_query("SELECT c.contract_id, (SELECT count(*) FROM investor i WHERE i.contract_id = c.contract_id AND i.is_deleted = 0) AS investors, (SELECT count(*) FROM investment v WHERE v.contract_id = c.contract_id AND v.is_deleted = 0) AS investments, (SELECT count(*) FROM sub_contract s WHERE s.main_contract_id = c.contract_id AND s.is_deleted = 0) AS later_acts, (SELECT count(*) FROM contract_place p WHERE p.contract_id = c.contract_id AND p.is_deleted = 0) AS places FROM contract c")
def dependents(a: Archive) -> DataFrame:
    """What depends on each act."""
    out = a.contract.select("contract_id")
    for name, rows in (("investors", a.live_investor), ("investments", a.live_investment), ("later_acts", a.live_sub_contract.select(F.col("main_contract_id").alias("contract_id"))), ("places", a.live_contract_place)):
        out = out.join(rows.groupBy("contract_id").agg(F.count("*").alias(name)), "contract_id", "left")
    return out.fillna(0)


@archive_query("SELECT p.person_id, p.last_name, count(DISTINCT i.contract_id) AS contracts, array_to_string(list_sort(list_distinct(list(i.profession) FILTER (WHERE i.profession <> ''))), '; ') AS professions FROM person p LEFT JOIN investor i ON i.person_id = p.person_id AND i.is_deleted = 0 WHERE p.is_deleted = 0 AND p.last_name ILIKE '%str%' GROUP BY 1, 2")
def person_search(a: Archive) -> DataFrame:
    """People by name with their distinct acts and professions; live investors only, in the join."""
    people = a.live_person.where(F.col("last_name").ilike("%str%")).select("person_id", "last_name")
    held = a.live_investor.select("person_id", "contract_id", "profession").join(people, "person_id", "left_semi").groupBy("person_id").agg(F.countDistinct("contract_id").alias("contracts"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("profession") != "", F.col("profession")))), "; ").alias("professions"))
    return people.join(held, "person_id", "left").select("person_id", "last_name", F.coalesce("contracts", F.lit(0)).alias("contracts"), F.nullif("professions", F.lit("")).alias("professions"))


@archive_query("WITH j AS (SELECT g.investment_id, count(DISTINCT i.person_id) AS people FROM investor_group g JOIN investor i ON i.investor_id = g.investor_id WHERE g.is_deleted = 0 AND i.is_deleted = 0 GROUP BY 1) SELECT people, count(*) AS investments FROM j GROUP BY 1")
def joint_investments(a: Archive) -> DataFrame:
    """Investments by their number of distinct people."""
    rows = a.live_investor_group.select("investor_id", "investment_id").join(a.live_investor.select("investor_id", "person_id"), "investor_id")
    return rows.groupBy("investment_id").agg(F.countDistinct("person_id").alias("people")).groupBy("people").agg(F.count("*").alias("investments"))


@archive_query("SELECT contract_id, registration_date, firm_name FROM contract WHERE is_deleted = 0 AND ec_discretion = 1 AND contract_id IN (SELECT cp.contract_id FROM contract_place cp JOIN place p ON p.place_id = cp.place_id WHERE cp.is_deleted = 0 AND p.place_name = 'NATION_7') AND substr(registration_date, 1, 4) >= '1994' ORDER BY 1, 2, 3 LIMIT 5000")
def builder_list(a: Archive) -> DataFrame:
    """Q25: a list of acts by year, place and flag."""
    return builder.compile_spec(a, {"subject": "contracts", "measure": "list", "filters": [{"id": "reg_year_from", "value": 1994}, {"id": "place_is", "value": "NATION_7"}, {"id": "ec_discretion_yes"}]})


@archive_query(f"SELECT CAST(substr(registration_date, 1, 3) || '0' AS INTEGER) AS decade, count(*) AS n FROM investor i JOIN person p ON p.person_id = i.person_id JOIN contract c ON c.contract_id = i.contract_id WHERE i.is_deleted = 0 AND c.is_deleted = 0 AND p.is_woman = 1 AND {DATED} AND i.investor_id IN (SELECT ig.investor_id FROM investor_group ig JOIN investment v ON v.investment_id = ig.investment_id WHERE v.is_deleted = 0 AND v.type = 'gp') GROUP BY 1")
def builder_women_by_decade(a: Archive) -> DataFrame:
    """Q25: women who are general partners, by decade."""
    return builder.compile_spec(a, {"subject": "investors", "group_by": "decade", "filters": [{"id": "gender_women"}, {"id": "role_gp"}]})


@archive_query("SELECT cu.currency AS currency, round(avg(CAST(total AS DOUBLE)), 2) AS avg_total FROM contract c JOIN currency cu ON cu.currency_id = c.currency_id WHERE c.is_deleted = 0 AND regexp_matches(total, '^[0-9]') AND c.economic_sector IN (SELECT ec_activity_id FROM economic_activity WHERE activity ILIKE '%negozio%') GROUP BY 1")
def builder_average_by_currency(a: Archive) -> DataFrame:
    """Q25: mean capital by currency for an activity."""
    return builder.compile_spec(a, {"subject": "contracts", "measure": "avg_total", "group_by": "currency", "filters": [{"id": "activity_contains", "value": "negozio"}]})


@archive_query(f"WITH n AS (SELECT CAST(substr(registration_date, 1, 3) || '0' AS INTEGER) AS decade, count(*) AS n FROM contract WHERE is_deleted = 0 AND {DATED} GROUP BY 1) SELECT CAST(d AS INTEGER) AS decade, coalesce(n, 0) AS contracts FROM range(1900, 2031, 10) r(d) LEFT JOIN n ON n.decade = d")
def decade_dense(a: Archive) -> DataFrame:
    """A dense axis of decades, empty ones 0."""
    axis = a.place.sparkSession.range(1900, 2031, 10).select(F.col("id").cast("int").alias("decade"))
    n = a.live_contract.where(~blank_date("registration_date")).groupBy(decade("registration_date").alias("decade")).agg(F.count("*").alias("contracts"))
    return axis.join(n, "decade", "left").fillna(0)


@archive_query("WITH t AS (SELECT title_id, title_name, CASE title_name WHEN 'signore' THEN 'signor' WHEN 'Signor' THEN 'signor' WHEN 'senatore' THEN 'senator' WHEN 'chiarissimo senator' THEN 'clarissimo senator' ELSE title_name END AS signature FROM title) SELECT signature, array_to_string(list_sort(list(title_name)), ' | ') AS terms FROM t GROUP BY 1 HAVING count(DISTINCT title_id) > 1")
def title_families(a: Archive) -> DataFrame:
    """Titles that differ in spelling alone."""
    t = a.title.withColumn("signature", tx.title_signature(F.col("title_name"))).where("signature <> ''")
    return t.groupBy("signature").agg(F.array_join(F.array_sort(F.collect_list("title_name")), " | ").alias("terms"), F.countDistinct("title_id").alias("n")).where("n > 1").select("signature", "terms")


# Joins of presence and intervals


@archive_query("WITH c AS (SELECT DISTINCT trim(folder) AS register FROM contract), s AS (SELECT DISTINCT trim(folder) AS register FROM sub_contract) SELECT coalesce(c.register, s.register) AS register, c.register IS NOT NULL AS contract_present, s.register IS NOT NULL AS later_present FROM c FULL JOIN s ON s.register = c.register")
def coverage(a: Archive) -> DataFrame:
    """Registers by the sources that have them."""
    reg = F.trim("folder").alias("register")
    return sequence.presence({"contract": a.contract.select(reg), "later": a.sub_contract.select(reg)}, "register")


@query("WITH s AS (SELECT event_id, user_id, ts, event_type FROM events WHERE event_type = 'signup'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') SELECT s.event_id AS a, e.event_id AS b FROM s JOIN e ON e.user_id = s.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 1 DAY")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that fall in another's interval, keyed by user so that only a user's rows meet."""
    e = _read(spark, sf_dir, "events")
    s = e.where("event_type = 'signup'").select(F.col("event_id").alias("a"), "user_id", F.col("ts").alias("lo"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("hi"))
    x = e.where("event_type = 'error'").select(F.col("event_id").alias("b"), "user_id", "ts")
    return s.join(x, (s.user_id == x.user_id) & (F.col("ts") >= F.col("lo")) & (F.col("ts") <= F.col("hi"))).select("a", "b")


# Order-dependent computations


@query("SELECT conv_id, turn, max_by(turn, turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS label_turn FROM conversations")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label at or before each paragraph (user turns stand for labels)."""
    c = _read(spark, sf_dir, "conversations").withColumn("own", F.when(F.col("role") == "user", F.col("turn")))
    return sequence.carry_forward(c, "conv_id", "turn", "own", "label_turn").select("conv_id", "turn", "label_turn")


@query("""WITH x AS (SELECT conv_id AS k, turn AS i, role = 'user' AS label, role <> 'user' AND length(coalesce(text, '')) <= 120 AS context FROM conversations),
y AS (SELECT *, max(CASE WHEN label OR NOT context THEN i END) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop, min(i) OVER (PARTITION BY k) AS f FROM x),
s AS (SELECT DISTINCT k, coalesce(stop + 1, f) AS i FROM y WHERE label),
m AS (SELECT x.k, x.i, count(s.i) OVER (PARTITION BY x.k ORDER BY x.i ROWS UNBOUNDED PRECEDING) AS entry FROM x LEFT JOIN s ON s.k = x.k AND s.i = x.i)
SELECT k AS conv_id, entry, min(i) AS first_index, max(i) AS last_index, count(*) AS rows FROM m WHERE entry > 0 GROUP BY 1, 2""")
def segment_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that labels open, with the context before them."""
    c = _read(spark, sf_dir, "conversations")
    label = F.col("role") == "user"
    return sequence.segments(c, "conv_id", "turn", label, ~label & (F.length(F.coalesce("text", F.lit(""))) <= 120))


@query("WITH k AS (SELECT doc_id, source || ':' || lang AS key, sha256(coalesce(text, '')) AS h, count(*) OVER (PARTITION BY source || ':' || lang) AS n FROM documents), j AS (SELECT doc_id, CASE WHEN n > 1 THEN key || '_' || substr(h, 1, 8) ELSE key END AS k FROM k), r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS m FROM j) SELECT doc_id, CASE WHEN m > 0 THEN k || '_' || CAST(m AS VARCHAR) ELSE k END AS entry_key FROM r")
def key_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colliding keys told apart by content, then by order."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(":"), "lang").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return sequence.unique_keys(d, "key", "text", "doc_id", "entry_key").select("doc_id", "entry_key")


@query("WITH r AS (SELECT user_id, event_id, value, row_number() OVER w AS rank, value - lead(value) OVER w AS margin FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank, round(margin, 6) AS margin FROM r WHERE rank <= 5")
def topk_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of each key and the distance to the next."""
    e = _read(spark, sf_dir, "events").where("value is not null")
    return sequence.margins(e, "user_id", "value", "event_id").select("user_id", "event_id", "rank", F.round("margin", 6).alias("margin"))


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key."""
    return oplog.latest(_read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1")
def best_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each key, the first on ties."""
    e = _read(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", "value")
    return sequence.best(e, ["user_id"], "value", "event_id").select("user_id", "event_id", "value")


@query("WITH o AS (SELECT user_id, event_type, event_id FROM events WHERE event_type IN ('error', 'purchase')), l AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM o GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS pk FROM l WHERE t = 'error'")
def hidden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose last delete or restore is a delete (errors and purchases stand for them)."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "restore")
    e = _read(spark, sf_dir, "events").select(F.lit("t").alias("db_table"), F.col("user_id").cast("string").alias("pk"), op.alias("op"), F.col("event_id").alias("seq"))
    return oplog.hidden(e).select("pk")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 'a' AS state, 0 AS gone, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS conflicts FROM events
UNION ALL SELECT f.user_id, o.k, CASE WHEN t = 'view' AND state = 'a' THEN 'b' WHEN t = 'click' AND state = 'b' THEN 'a' ELSE state END, CASE t WHEN 'error' THEN 1 WHEN 'purchase' THEN 0 ELSE gone END,
applied + CASE WHEN t IN ('error', 'purchase') OR (t = 'view' AND state = 'a') OR (t = 'click' AND state = 'b') THEN 1 ELSE 0 END,
conflicts + CASE WHEN t = 'signup' OR (t = 'view' AND state <> 'a') OR (t = 'click' AND state <> 'b') THEN 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT 't' AS db_table, CAST(user_id AS VARCHAR) AS pk, '{"state": "' || state || '"}' AS row, gone AS is_deleted, applied, conflicts FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def replay_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log folded over a seed; each user's events are operations on that user's record."""
    e = _read(spark, sf_dir, "events")
    seed = e.select(F.lit("t").alias("db_table"), F.col("user_id").cast("string").alias("pk")).distinct().withColumn("row", F.to_json(F.struct(F.lit("a").alias("state"))))
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "restore").when(F.col("event_type") == "signup", "create").otherwise("update")
    after = F.when(F.col("event_type") == "signup", F.to_json(F.struct(F.lit("n").alias("state")))).otherwise(F.when(F.col("event_type") == "view", '"b"').otherwise('"a"'))
    ops = e.select(F.lit("t").alias("db_table"), F.col("user_id").cast("string").alias("pk"), F.col("event_id").alias("seq"), op.alias("op"), F.lit("state").alias("field"), F.when(F.col("event_type") == "view", '"a"').otherwise('"b"').alias("before"), after.alias("after"))
    return oplog.replay(seed, ops)


# Text


_FOLD = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '<[^>]+>', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_FOLD}) AS folded FROM documents")
def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the folded text, as a digest."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.match_text(F.col("text")), 256).alias("folded"))


@query(f"WITH t AS (SELECT doc_id, string_split({_FOLD}, ' ') AS w FROM documents) SELECT doc_id, CAST(len(list_filter(w, lambda x: length(x) > 2 AND NOT list_contains([{', '.join(repr(s) for s in tx.STOPWORDS)}], x) AND NOT regexp_full_match(x, '[0-9]+'))) AS INTEGER) AS tokens FROM t")
def match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """words that count in comparisons."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(tx.match_tokens(F.col("text"))).alias("tokens"))


_TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(f"WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents), l AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: starts_with(x, 'ther'))) AS b FROM w), s AS (SELECT count(*) AS n, avg(n) AS mean, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM l), c AS (SELECT doc_id, greatest(ln((s.n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l.n / mean)) + greatest(ln((s.n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l.n / mean)) AS score FROM l, s WHERE a > 0 AND b > 0) SELECT 'document' AS kind, doc_id AS ref, round(score, 6) AS score FROM c ORDER BY round(score, 9) DESC, doc_id LIMIT 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five documents with a word and a prefix, accents folded."""
    return search.search(_texts(spark, sf_dir), "the ther", 5)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("ref"), F.lit("").alias("title"), F.col("text").alias("body"))


@query(f"WITH w AS (SELECT {_TOKENS} AS w FROM documents) SELECT t.term, CAST(sum(CASE WHEN len(list_filter(w, lambda x: x = t.term)) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS docs FROM w, (VALUES ('the'), ('sch'), ('zzz')) t(term) GROUP BY 1")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each word of a query that finds nothing as a whole."""
    return search.term_counts(_texts(spark, sf_dir), "the sch zzz")


@archive_query("SELECT 'contract' AS kind, contract_id AS ref FROM contract WHERE is_deleted = 0 AND contract_id = 7 UNION ALL SELECT 'sub_contract', contract_id FROM sub_contract WHERE is_deleted = 0 AND contract_id = 7 UNION ALL SELECT 'person', person_id FROM person WHERE is_deleted = 0 AND person_id = 7")
def id_jump(a: Archive) -> DataFrame:
    """Records whose id is the number that was typed."""
    return search.id_jump(a, "7")


@query("SELECT doc_id, CASE WHEN p = 0 THEN array_to_string(w[1:12], ' ') || CASE WHEN len(w) > 12 THEN '…' ELSE '' END ELSE CASE WHEN s > 1 THEN '…' ELSE '' END || array_to_string(list_transform(w[s:s + 11], lambda x: CASE WHEN x = 'the' THEN '«' || x || '»' ELSE x END), ' ') || CASE WHEN s + 11 < len(w) THEN '…' ELSE '' END END AS snippet FROM (SELECT doc_id, w, coalesce(list_position(w, 'the'), 0) AS p, greatest(1, coalesce(list_position(w, 'the'), 0) - 5) AS s FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \n\t\r]+'), lambda x: x <> '') AS w FROM documents))")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve words around the first that was searched for, marked."""
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", search.snippet(F.col("text"), ["the"]).alias("snippet"))


@query("WITH v AS (SELECT * FROM (VALUES (1, 'Setaiolo e merciaio'), (2, 'merciaio, setaiolo'), (3, 'negotio di cuoiaio'), (4, 'quoiaio in negozzio'), (5, 'lanaiolo'), (6, 'linaiolo')) t(id, term)) SELECT 'merciaio setaiolo' AS signature, 2::BIGINT AS n UNION ALL SELECT 'cuoiaio negozio', 2::BIGINT")
def activity_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities that differ in spelling and order alone."""
    terms = [(1, "Setaiolo e merciaio"), (2, "merciaio, setaiolo"), (3, "negotio di cuoiaio"), (4, "quoiaio in negozzio"), (5, "lanaiolo"), (6, "linaiolo")]
    t = spark.createDataFrame(terms, "id int, term string").withColumn("signature", tx.activity_signature(F.col("term")))
    return t.groupBy("signature").agg(F.countDistinct("id").alias("n")).where("n > 1")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders WHERE o_orderdate IS NOT NULL")
def italian_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dates written out in Italian and read again (years moved into the sources' range for reading)."""
    names = [m for m in list(tx.MONTHS)[:12]]
    o = _read(spark, sf_dir, "orders").where("o_orderdate is not null")
    month = F.array(*[F.lit(m) for m in names])[F.month("o_orderdate") - 1]
    written = F.concat_ws(" ", F.lit("addì"), F.dayofmonth("o_orderdate").cast("string"), month, (F.year("o_orderdate") - 300).cast("string"), F.lit("in Firenze"))
    iso = tx.italian_date(written)
    return o.select(F.col("o_orderkey").alias("id"), F.concat((F.substring(iso, 1, 4).cast("int") + 300).cast("string"), F.substring(iso, 5, 6)).alias("iso"))


@query("SELECT l_suppkey, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS review, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 1) AS pct FROM lineitem GROUP BY 1 HAVING count(*) >= 30")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts and shares of each key, partial sums first."""
    flag = F.col("l_returnflag") == "R"
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(flag).alias("review"), F.count("*").alias("n"), F.round(F.lit(100.0).cast("double") * F.count_if(flag) / F.count("*"), 1).alias("pct"))
    return rows.where("n >= 30")


@archive_query("SELECT s.main_contract_id AS contract_id, s.contract_id AS later_id, row_number() OVER (PARTITION BY s.main_contract_id ORDER BY s.registration_date, s.contract_id) AS nth, count(*) OVER (PARTITION BY s.main_contract_id) AS total FROM sub_contract s WHERE s.is_deleted = 0 QUALIFY nth <= 24")
def capped_sources(a: Archive) -> DataFrame:
    """The first 24 later acts of each act, with their whole number."""
    w = Window.partitionBy("main_contract_id")
    rows = a.live_sub_contract.select(F.col("main_contract_id"), F.col("contract_id").alias("later_id"), "registration_date")
    rows = rows.withColumn("nth", F.row_number().over(w.orderBy("registration_date", "later_id")).cast("long")).withColumn("total", F.count("*").over(w))
    return rows.where("nth <= 24").select(F.col("main_contract_id").alias("contract_id"), "later_id", "nth", "total")


@query("WITH c AS (SELECT user_id, event_id, value * 1.5 AS score, event_type = 'error' AS bad FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM c), p AS (SELECT user_id, max(score) FILTER (WHERE rank = 1) AS a, max(score) FILTER (WHERE rank = 2) AS b, bool_or(bad) FILTER (WHERE rank = 1) AS bad FROM r GROUP BY 1) SELECT user_id AS entry_id, CASE WHEN a >= 85 AND a - coalesce(b, 0) >= 12 AND NOT bad THEN 'matched_high_confidence' WHEN a >= 65 AND a - coalesce(b, 0) >= 8 THEN 'matched_candidate' WHEN a >= 45 THEN CASE WHEN b IS NOT NULL THEN 'ambiguous' ELSE 'matched_candidate' END ELSE 'word_only' END AS status, round(a - coalesce(b, 0), 6) AS margin FROM p")
def classify_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each entry by its best candidates (events stand for candidates of their user)."""
    from ..operators import linkage

    e = _read(spark, sf_dir, "events").where("value is not null")
    none, bad = F.array().cast("array<string>"), F.array(F.lit("registration_date_differs"))
    c = e.select(F.col("user_id").alias("entry_id"), F.col("event_id").alias("row_id"), F.lit(0).alias("rule"), F.lit("contract").alias("db_table"), F.lit(None).cast("long").alias("main_contract_id"), *(F.lit(None).cast("string").alias(x) for x in ("registration_date", "folio_start", "folio_end")), F.lit(0.0).alias("strength"), none.alias("signals"), F.when(F.col("event_type") == "error", bad).otherwise(none).alias("conflicts"), (F.col("value") * 1.5).alias("score"))
    return linkage.classify(linkage.top(c)).select("entry_id", "status", F.round("margin", 6).alias("margin"))


@query()
def linkage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as rows against documents that share their first word as number; scored and ranked."""
    from ..operators import linkage

    word = F.xxhash64(F.get(tx.match_tokens(F.col("text")), F.lit(0)))
    none, text = F.lit(None).cast("string"), F.array().cast("array<string>")
    e = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.lit("r").alias("register_id"), F.lit("new_contract").alias("label"), word.alias("event_number"), F.lit(None).cast("long").alias("reference_number"), text.alias("dates"), text.alias("stile_dates"), none.alias("folio_start"), none.alias("folio_end"), "text")
    r = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.lit("contract").alias("db_table"), word.alias("contract_id"), F.lit(None).cast("long").alias("main_contract_id"), F.lit("r").alias("register_id"), none.alias("registration_date"), none.alias("sub_type"), none.alias("folio_start"), none.alias("folio_end"), "text")
    return linkage.top(linkage.score(linkage.block(e, r), e, r)).select("entry_id", "row_id", "rank", "score", "signals", "conflicts")
