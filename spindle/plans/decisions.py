"""Queries of links, review, proposals, shares, groups and maps over the archive's views and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, vocabulary
from ..sources.archive import Archive
from .registry import archive_query, query


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(*values: str):
    return F.array(*map(F.lit, values)).cast("array<string>")


_STATUS = ("matched_high_confidence", "matched_candidate", "ambiguous", "word_only")


@query(
    "WITH a AS (SELECT event_id AS k, event_id // 4 AS e, event_id % 4 + 1 AS rank, 60 + event_id % 3 * 15 AS score, event_type AS t, coalesce(value, 0) / 100 AS ratio, user_id % 2 AS main, event_id % 6 = 0 AS act, "
    "event_id % 5 IN (0, 2) AS told, event_id % 5 IN (0, 1) AS good, event_id % 7 < 4 AS leaf, event_id % 2 = 1 AS alike, event_id % 11 >= 9 AS fields FROM events), "
    "b AS (SELECT *, (score >= 85 OR score >= 65 AND good AND leaf) AND (t <> 'signup' OR k % 5 = 0) AS loose, t <> 'signup' AND (alike OR fields) AND score >= 65 AS second FROM a), "
    "c AS (SELECT *, loose AND t <> 'error' AS strict FROM b), "
    "d AS (SELECT e, count(*) FILTER (WHERE strict) AS ns, count(*) FILTER (WHERE loose) AS nl, min(rank) FILTER (WHERE strict) AS lead FROM c GROUP BY 1), "
    "f AS (SELECT c.*, CASE WHEN ns >= 2 THEN strict WHEN e % 5 = 0 AND nl >= 2 THEN loose WHEN e % 4 = 0 AND ns > 0 THEN rank = lead WHEN e % 4 = 1 THEN rank = 1 WHEN e % 4 = 2 THEN loose ELSE false END AS chosen FROM c JOIN d USING (e)), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY chosen DESC, rank) AS place FROM f WHERE chosen OR e % 6 = 0 AND second), h AS (SELECT * FROM g WHERE place = 1 OR NOT act OR told), "
    "s AS (SELECT e, count(*) AS n, count(*) FILTER (WHERE act) AS acts, count(DISTINCT main) AS mains, count(DISTINCT t) AS kinds, count(*) FILTER (WHERE k = 4 * e + 1 OR main = 4 * e + 1) AS hits, max(ratio, 2) AS two FROM h GROUP BY 1), "
    "r AS (SELECT h.*, n, CASE WHEN e % 6 <> 0 AND n > 1 AND acts = 0 AND (mains = 1 OR kinds = 1) AND (hits = 1 OR two[1] - two[2] >= 0.15) THEN CASE WHEN CASE WHEN hits = 1 THEN k = 4 * e + 1 OR main = 4 * e + 1 ELSE ratio = two[1] END THEN 'primary' ELSE 'alternative' END ELSE 'primary' END AS role FROM h JOIN s USING (e)) "
    "SELECT e AS entry_id, row_number() OVER (PARTITION BY e ORDER BY role DESC, place) AS ordinal, k AS row_id, role, role = 'alternative' OR count(*) FILTER (WHERE role = 'primary') OVER (PARTITION BY e) <> 1 OR t IN ('error', 'signup') OR e % 4 <> 0 AS needs_review FROM r"
)
def link_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that entries are linked to, with roles (four events stand for an entry's candidates)."""
    k = F.col("event_id")
    entry = F.floor(k / 4)
    signals = F.when(k % 5 == 0, _texts("contract_id_exact", "registration_date_exact", "text_similarity_good")).when(k % 5 == 1, _texts("text_similarity_good")).when(k % 5 == 2, _texts("main_contract_id_referenced")).otherwise(_texts())
    conflicts = F.when(F.col("event_type") == "error", _texts("registration_date_differs")).when(F.col("event_type") == "signup", _texts("folio_differs")).otherwise(_texts())
    c = _read(spark, sf_dir, "events").select(
        entry.alias("entry_id"), (k % 4 + 1).alias("rank"), k.alias("row_id"), F.when(k % 6 == 0, "contract").otherwise("sub_contract").alias("db_table"), k.alias("contract_id"), (F.col("user_id") % 2).alias("main_contract_id"),
        F.col("event_type").alias("sub_type"), (60 + k % 3 * 15).alias("score"), signals.alias("signals"), conflicts.alias("conflicts"), F.when(k % 2 == 1, 0.6).otherwise(0.1).alias("strength"),
        (F.coalesce("value", F.lit(0.0)) / 100).alias("ratio"), F.when(k % 7 < 4, "folio_exact").alias("folio_relation"), F.lit(0.0).alias("word_coverage_in_db"), F.lit(0).alias("phrase"), F.when(k % 11 >= 9, 5).otherwise(0).alias("fields"),
    )
    e = F.col("entry_id")
    entries = c.select("entry_id").distinct().select(e, _texts(*_STATUS)[(e % 4).cast("int")].alias("status"), (e % 5 == 0).alias("combined"), (e % 6 == 0).alias("several"), F.array(4 * e + 1).alias("numbers"))
    return decisions.select_links(c, entries).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(
    "SELECT bucket, CAST(CASE bucket WHEN 'Choose the right row' THEN 0 WHEN 'Verify a field' THEN 1 WHEN 'Investigate — no clear DB match' THEN 2 WHEN 'Confirm combined act' THEN 3 WHEN 'Confirm the link' THEN 4 ELSE 6 END AS BIGINT) AS place, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 3 THEN CASE WHEN event_type = 'view' THEN 'Non-accomandita (Word-only)' ELSE 'Investigate — no clear DB match' END "
    "WHEN event_id % 4 = 2 THEN CASE WHEN event_id % 3 = 2 THEN 'Confirm combined act' ELSE 'Choose the right row' END WHEN event_type IN ('error', 'purchase') THEN CASE WHEN event_id % 5 <= 1 OR value >= 60 THEN 'Verify a field' ELSE 'Choose the right row' END WHEN event_id % 3 = 2 THEN 'Confirm combined act' ELSE 'Confirm the link' END AS bucket FROM events) GROUP BY 1"
)
def qa_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by what a reviewer has to do, in the order of review."""
    k, kind = F.col("event_id"), F.col("event_type")
    signals = F.when(k % 5 == 0, _texts("component_contract_id_exact")).when(k % 5 == 1, _texts("registration_date_stile_fiorentino", "firm_name_overlap")).when(k % 5 == 2, _texts("registration_date_exact")).otherwise(_texts("firm_name_overlap"))
    conflicts = F.when(kind.isin("error", "purchase"), _texts("folio_differs")).otherwise(_texts())
    name = decisions.bucket(_texts(*_STATUS)[(k % 4).cast("int")], F.when(kind == "view", "without_accomandita"), k % 3, signals, conflicts, F.col("value") / 100)
    return _read(spark, sf_dir, "events").groupBy(name.alias("bucket")).agg(F.count("*").alias("n")).withColumn("place", decisions.bucket_rank(F.col("bucket")))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 3 THEN CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderkey || ',' || (o_orderkey + 1) END WHEN 1 THEN CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey + 1 AS VARCHAR) END WHEN 4 THEN CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey + 1 AS VARCHAR) END ELSE '' END AS ticked FROM orders")
def preselected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are ticked when a case is opened."""
    k = F.col("o_orderkey")
    suggested = F.slice(F.array(k, k + 1), F.lit(1), (k % 3).cast("int"))
    ticked = decisions.preselected(_texts(*decisions.BUCKETS)[(k % 7).cast("int")], F.when(k % 2 == 1, F.array(k)).otherwise(F.slice(F.array(k), 1, 0)), suggested, k + 1)
    return _read(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(ticked.cast("array<string>"), ",").alias("ticked"))


@archive_query("WITH h AS (SELECT g.investor_id, g.investment_id, i.is_joint AS j, count(*) OVER (PARTITION BY g.investment_id) AS n FROM investor_group g JOIN investor i ON i.investor_id = g.investor_id WHERE g.is_deleted + i.is_deleted = 0) SELECT investor_id, investment_id, CAST(j AS INTEGER) AS before, CAST(1 - j AS INTEGER) AS after FROM h WHERE (j = 1) <> (n > 1)")
def joint_changes(a: Archive) -> DataFrame:
    """Marks of joint stakes that do not fit the live shares."""
    return decisions.joint_changes(a.investor, a.investor_group)


@query("WITH p AS (SELECT DISTINCT user_id AS u FROM events), d AS (SELECT user_id AS u, min(event_id) AS decided, arg_min(event_type, event_id) AS t FROM events WHERE event_type IN ('view', 'error') GROUP BY 1), a AS (SELECT u, (SELECT min(event_id) FROM events WHERE user_id = u AND event_type = 'purchase' AND event_id > decided) AS applied FROM d WHERE t = 'view' AND u % 5 <> 0), r AS (SELECT u, (SELECT min(event_id) FROM events WHERE user_id = u AND event_type = 'signup' AND event_id > applied) AS reverted FROM a) SELECT p.u AS proposal_id, CASE WHEN reverted > -1 THEN 'reverted' WHEN applied > -1 THEN 'applied' WHEN t = 'view' THEN 'approved' WHEN t = 'error' THEN 'rejected' ELSE 'proposed' END AS status, decided, applied, reverted FROM p LEFT JOIN d USING (u) LEFT JOIN a USING (u) LEFT JOIN r USING (u)")
def proposal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where proposals stand after their log of steps; every fifth has drifted from its live value."""
    e, u = _read(spark, sf_dir, "events"), F.col("user_id")
    steps = F.create_map(*[F.lit(x) for kv in {"view": "approve", "error": "reject", "purchase": "apply", "signup": "revert", "click": "comment"}.items() for x in kv])
    proposals = e.select(u.alias("proposal_id")).distinct().withColumns({"before": F.lit("a"), "live": F.when(F.col("proposal_id") % 5 == 0, "b").otherwise("a")})
    return decisions.proposal_states(proposals, e.select(u.alias("proposal_id"), steps[F.col("event_type")].alias("action"), F.col("event_id").alias("seq")))


@query("WITH c AS (SELECT event_id, value >= 30 AS a, user_id % 3 <> 0 AS b, event_type <> 'click' AS d, event_type = 'view' AS x, event_id % 10 <= 7 AS y FROM events) SELECT 'reliable' AS step, count(*) FILTER (WHERE a) AS n FROM c UNION ALL SELECT 'parseable', count(*) FILTER (WHERE a AND b) FROM c UNION ALL SELECT 'no_apparatus', count(*) FILTER (WHERE a AND b AND d) FROM c UNION ALL SELECT 'tracked', count(*) FILTER (WHERE a AND b AND d AND x) FROM c UNION ALL SELECT 'small_gap', count(*) FILTER (WHERE a AND b AND d AND NOT x AND y) FROM c")
def date_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many date conflicts pass each gate."""
    kind = F.col("event_type")
    gates = [("reliable", F.col("value") >= 30), ("parseable", F.col("user_id") % 3 != 0), ("no_apparatus", kind != "click")]
    return decisions.funnel(_read(spark, sf_dir, "events"), gates, [("tracked", kind == "view"), ("small_gap", (kind != "view") & (F.col("event_id") % 10 <= 7))])


@query("SELECT CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'verbatim|san ' || o_custkey % 50 ELSE 'firenze ' || o_custkey % 20 || '|city|0|' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'toscana' END END AS key, min(o_orderkey % 97 / 97) AS confidence, count(*) AS members, min(o_orderkey) AS first_id FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY 1 HAVING count(*) > 1")
def place_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that resolve to the same (orders stand for them)."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    rows = _read(spark, sf_dir, "orders").select(
        k.alias("place_id"), F.concat(F.lit("san "), (n % 50).cast("string")).alias("signature"), F.concat(F.when(k % 2 == 0, " Firenze ").otherwise("FIRENZE "), (n % 20).cast("string")).alias("modern_name"),
        _texts("city", "parish", "area", "unknown")[(k % 4).cast("int")].alias("feature_type"), F.lit(0).alias("is_area"), F.when(k % 3 != 0, " Toscana").alias("admin_region"), (k % 97 / 97).alias("confidence"),
    )
    return decisions.resolution_groups(rows)


@archive_query("WITH u AS (SELECT place_id, count(*) AS n FROM contract_place WHERE is_deleted = 0 GROUP BY 1) SELECT place_id, p.place_name, n, round(ln(n + 1) / ln((SELECT max(n) FROM u JOIN place USING (place_id)) + 1), 6) AS size FROM u JOIN place p USING (place_id)")
def map_points(a: Archive) -> DataFrame:
    """Places with their use and the size of their mark."""
    used = a.live_contract_place.groupBy("place_id").agg(F.count("*").alias("n")).join(a.place, "place_id")
    return decisions.sized_points(used).withColumn("size", F.round("size", 6)).select("place_id", "place_name", "n", "size")


_X, _Y = "c_custkey * 37 % 1009", "c_custkey * 91 % 997"


@query(f"WITH p AS (SELECT c_custkey AS k, {_X} AS x, {_Y} AS y FROM customer) SELECT a.k AS asked_id, b.k AS point_id FROM p a, p b WHERE a.k % 50 = 0 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 625")
def stacked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within a radius of those that are asked for."""
    p = _read(spark, sf_dir, "customer").selectExpr("c_custkey AS point_id", f"{_X} AS x", f"{_Y} AS y")
    return decisions.within_radius(p.where("point_id % 50 = 0").withColumnRenamed("point_id", "asked_id"), p, 25.0)


@archive_query("WITH e AS (SELECT contract_id AS k, trim(folder) AS reg, CAST(regexp_extract(folio, '[0-9]+') AS INTEGER) AS n FROM contract), m AS (SELECT DISTINCT folder AS reg, CAST(regexp_extract(folio, '[0-9]+') AS INTEGER) AS n FROM sub_contract WHERE is_deleted = 0) SELECT k AS entry_id, reg || '/' || m.n AS path, m.n AS folio, CASE WHEN m.n = e.n THEN 'start' ELSE 'end' END AS role FROM e JOIN m USING (reg) WHERE m.n = e.n OR k % 3 <> 0 AND m.n = e.n + 1")
def image_links(a: Archive) -> DataFrame:
    """Scans of the leaves where acts start and end."""
    leaf, k = F.regexp_extract("folio", r"\d+", 0).cast("int"), F.col("contract_id")
    entries = a.contract.select(k.alias("entry_id"), F.trim("folder").alias("register_id"), leaf.alias("folio_start"), F.when(k % 3 == 0, leaf).otherwise(leaf + 1).alias("folio_end"))
    scans = a.live_sub_contract.select(F.col("folder").alias("register_id"), leaf.alias("folio")).distinct()
    return decisions.image_links(entries, scans.withColumn("path", F.concat_ws("/", "register_id", "folio")))


#: name -> signature, signature without figures
CURRENCIES = [
    ("Scudi d'oro larghi", "scudo · largo oro", "scudo · largo oro"), ("scudo di oro largo", "scudo · largo oro", "scudo · largo oro"), ("Scudi di lire 7", "scudo · lira=7", "scudo · lira"),
    ("scudi, lire 7 l'uno", "scudo · lira=7", "scudo · lira"), ("scudi di lire 7:10", "scudo · lira=7 soldo=10", "scudo · lira soldo"), ("scudi di lire 7 soldi 10", "scudo · lira=7 soldo=10", "scudo · lira soldo"),
    ("scudi di lire 8", "scudo · lira=8", "scudo · lira"), ("ducati di 10 carlini", "ducato · carlino=10", "ducato · carlino"), ("ducati di carlini", "ducato · §carlino", "ducato · §carlino"),
    ("Fiorini veneziani correnti", "fiorino · veneziana · corrente", "fiorino · veneziana · corrente"), ("pezze 3", "pezza · ?=3", "pezza · ?"), ("pezze 4", "pezza · ?=4", "pezza · ?"),
]
_VALUES = ", ".join("({}, '{}', '{}', '{}')".format(k, *(x.replace("'", "''") for x in c)) for k, c in enumerate(CURRENCIES))
_TERMS = f"WITH v(k, value, signature, skeleton) AS (VALUES {_VALUES}), t AS (SELECT p_partkey AS id, value, signature, skeleton, p_size AS n FROM part JOIN v ON k = p_partkey % {len(CURRENCIES)})"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _texts(*(c[0] for c in CURRENCIES))[(F.col("p_partkey") % len(CURRENCIES)).cast("int")]
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("value"), F.col("p_size").cast("long").alias("count"))


@query(f"{_TERMS} SELECT signature, count(DISTINCT id) AS members, CAST(sum(n) AS BIGINT) AS total FROM t GROUP BY 1 HAVING count(DISTINCT id) > 1")
def currency_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currencies that differ in spelling alone, with their use (parts stand for terms)."""
    return vocabulary.families(_terms(spark, sf_dir), "currency").select("signature", F.size("terms").cast("long").alias("members"), "total")


@query(f"{_TERMS}, m AS (SELECT skeleton, signature, arg_min(id, (-n, id)) AS id, max(n) AS n FROM t WHERE contains(signature, '=') GROUP BY 1, 2) SELECT skeleton, string_agg(CAST(id AS VARCHAR), ',' ORDER BY -n, id) AS terms, CAST(sum(n) AS BIGINT) AS total FROM m GROUP BY 1 HAVING count(*) > 1")
def currency_cautions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currencies that differ in their rate alone."""
    found = vocabulary.currency_cautions(_terms(spark, sf_dir))
    return found.select("skeleton", F.array_join(F.transform("terms", lambda x: x["id"].cast("string")), ",").alias("terms"), "total")
