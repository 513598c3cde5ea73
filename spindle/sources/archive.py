"""The archive's tables (acts, people, investments, places ...) as views over the driver's tables.

Each view is a list of (column, expression) over one source table. The expressions are in the SQL that Spark and DuckDB
share, so that one definition gives both the DataFrames and the common table expressions that check them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: In a definition {day:x} is column x as ISO text.
_DAY = {"spark": "date_format({}, 'yyyy-MM-dd')", "duckdb": "strftime({}, '%Y-%m-%d')"}

NAMES = "CASE {0} % 7 WHEN 0 THEN 'Salviati' WHEN 1 THEN 'Strozzi' WHEN 2 THEN 'Ricci' WHEN 3 THEN 'Capponi' WHEN 4 THEN '' WHEN 5 THEN 'Guadagni' ELSE 'Niccolini' END"
FIRST = "CASE {0} % 6 WHEN 0 THEN 'Maria' WHEN 1 THEN 'Cosimo' WHEN 2 THEN 'Lorenzo' WHEN 3 THEN '' WHEN 4 THEN 'Bernardo' ELSE 'Agnolo' END"

VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "contract": (
        "orders",
        [
            ("contract_id", "o_orderkey"),
            ("archive", "'ASF'"),
            ("series", "CASE WHEN o_orderkey % 4 = 3 THEN 'Camera di Commercio' ELSE 'Mercanzia' END"),
            ("folder", "CASE WHEN o_orderkey % 4 = 3 THEN '1263' ELSE concat(' ', CAST(10800 + o_orderkey % 40 AS STRING)) END"),
            ("folio", "concat(CAST(1 + o_orderkey % 190 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN 'r' ELSE 'v' END)"),
            ("registration_date", "CASE WHEN o_orderkey % 97 = 0 THEN '0000-00-00' WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN '' ELSE {day:o_orderdate} END"),
            ("firm_name", "CASE WHEN o_orderkey % 13 = 0 THEN '  ' ELSE concat('Firm ', CAST(o_custkey % 500 AS STRING)) END"),
            ("economic_sector", "CAST(CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN -o_orderkey ELSE o_orderkey % 28 END AS BIGINT)"),
            ("currency_id", "CAST(o_custkey % 6 AS BIGINT)"),
            ("total", "CASE WHEN o_orderkey % 31 = 0 THEN 'non detto' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END"),
            ("ec_discretion", "CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END"),
            ("duration_months", "CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE 12 * (o_orderkey % 9) END AS BIGINT)"),
            ("document", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('Atto di Firm ', CAST(o_custkey % 500 AS STRING), ' per scudi ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' ', o_orderpriority) END"),
            ("is_deleted", "CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END"),
        ],
    ),
    "investor": (
        "lineitem",
        [
            ("investor_id", "l_orderkey * 10 + l_linenumber"),
            ("person_id", "l_suppkey"),
            ("contract_id", "l_orderkey"),
            ("title", "CAST(l_linenumber % 5 AS BIGINT)"),
            ("place_of_residence", "CAST(l_partkey % 27 AS BIGINT)"),
            ("place_of_origin", "CAST(CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_suppkey % 26 END AS BIGINT)"),
            ("husband_first_name", "CASE WHEN l_partkey % 11 = 0 THEN 'Piero' ELSE NULL END"),
            ("husband_last_name", "CASE WHEN l_partkey % 22 = 0 THEN 'Bardi' ELSE NULL END"),
            ("profession", "CASE l_partkey % 4 WHEN 0 THEN 'battiloro' WHEN 1 THEN 'setaiolo' WHEN 2 THEN 'lanaiolo' ELSE '' END"),
            ("guardian_of", "CASE WHEN l_partkey % 16 = 0 THEN 'pupilli' ELSE '' END"),
            ("is_guardian", "CASE WHEN l_partkey % 8 = 0 THEN 1 ELSE 0 END"),
            ("is_widow", "CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 0 END"),
            ("is_jewish", "CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END"),
            ("jewish_db", "CASE WHEN l_suppkey % 12 = 0 THEN 1 ELSE 0 END"),
            ("via_proxy", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"),
            ("is_joint", "CASE WHEN l_linenumber <= 2 THEN 1 ELSE 0 END"),
            ("is_deleted", "CASE WHEN l_partkey % 40 = 3 THEN 1 ELSE 0 END"),
        ],
    ),
    "investment": (
        "lineitem",
        [
            ("investment_id", "l_orderkey * 10 + l_linenumber"),
            ("contract_id", "CASE WHEN l_partkey % 300 = 7 THEN l_orderkey + 1 WHEN l_partkey % 300 = 8 THEN -l_orderkey ELSE l_orderkey END"),
            ("type", "CASE WHEN l_linestatus = 'O' THEN 'gp' ELSE 'lp' END"),
            ("partnership_name", "CASE WHEN l_partkey % 6 = 0 THEN 'e compagni' ELSE '' END"),
            ("investment_cash", "CAST(CASE WHEN l_partkey % 10 = 1 THEN NULL WHEN l_partkey % 10 = 2 THEN 0 ELSE floor(l_extendedprice) END AS BIGINT)"),
            ("investment_non_cash", "CASE WHEN l_partkey % 14 = 0 THEN 'mercanzie' ELSE '' END"),
            ("is_deleted", "CASE WHEN l_partkey % 45 = 4 THEN 1 ELSE 0 END"),
        ],
    ),
    "investor_group": (
        "lineitem",
        [
            ("investor_id", "CASE WHEN l_partkey % 400 = 9 THEN -l_orderkey ELSE l_orderkey * 10 + l_linenumber END"),
            ("investment_id", "CASE WHEN l_partkey % 350 = 9 THEN -l_orderkey WHEN l_linenumber = 2 THEN l_orderkey * 10 + 1 ELSE l_orderkey * 10 + l_linenumber END"),
            ("is_deleted", "CASE WHEN l_partkey % 60 = 5 THEN 1 ELSE 0 END"),
        ],
    ),
    "person": (
        "supplier",
        [
            ("person_id", "s_suppkey"),
            ("first_name", FIRST.format("s_suppkey")),
            ("father_mother", "CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Giovanni' WHEN 2 THEN 'Filippo' WHEN 3 THEN 'Giovanni' ELSE NULL END"),
            ("grandfather", "CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Jacopo' ELSE '' END"),
            ("last_name", NAMES.format("s_suppkey")),
            ("nickname", "CASE WHEN s_suppkey % 10 = 0 THEN 'il Rosso' ELSE '' END"),
            ("is_woman", "CASE WHEN s_suppkey % 6 = 0 THEN 1 ELSE 0 END"),
            ("is_deleted", "CASE WHEN s_suppkey % 33 = 2 THEN 1 ELSE 0 END"),
        ],
    ),
    "sub_contract": (
        "events",
        [
            ("contract_id", "10000000 + event_id"),
            ("main_contract_id", "CAST(CASE WHEN event_id % 37 = 0 THEN -user_id - 1 ELSE user_id END AS BIGINT)"),
            ("folder", "concat('', CAST(10800 + event_id % 40 AS STRING))"),
            ("folio", "concat(CAST(1 + event_id % 190 AS STRING), 'r')"),
            ("registration_date", "CASE WHEN event_id % 53 = 0 THEN '0000-00-00' ELSE {day:ts} END"),
            ("sub_type", "CASE event_type WHEN 'signup' THEN 'renewal' WHEN 'purchase' THEN 'balance' WHEN 'error' THEN 'termination' WHEN 'view' THEN 'variation' ELSE CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '0' ELSE NULL END END"),
            ("sub_firm_name", "CASE WHEN event_id % 5 = 0 THEN 'Firm nuova' ELSE '' END"),
            ("document", "props"),
            ("is_deleted", "CASE WHEN event_id % 70 = 6 THEN 1 ELSE 0 END"),
        ],
    ),
    "contract_place": (
        "orders",
        [
            ("place_id", "CAST(o_custkey % 27 AS BIGINT)"),
            ("contract_id", "CASE WHEN o_orderkey % 701 = 5 THEN -o_orderkey ELSE o_orderkey END"),
            ("address", "CASE WHEN o_orderkey % 9 = 0 THEN 'Por Santa Maria' ELSE '' END"),
            ("is_deleted", "CASE WHEN o_orderkey % 29 = 8 OR o_orderkey % 3 = 0 THEN 1 ELSE 0 END"),
        ],
    ),
    "place": ("nation", [("place_id", "CAST(n_nationkey AS BIGINT)"), ("place_name", "CASE WHEN n_nationkey % 12 = 11 THEN concat(' ', lower(n_name)) ELSE n_name END")]),
    "title": ("region", [("title_id", "CAST(r_regionkey AS BIGINT)"), ("title_name", "CASE r_regionkey WHEN 0 THEN 'signore' WHEN 1 THEN 'Signor' WHEN 2 THEN 'messer' WHEN 3 THEN 'senatore' ELSE 'chiarissimo senator' END")]),
    "currency": ("region", [("currency_id", "CAST(r_regionkey AS BIGINT)"), ("currency", "CASE r_regionkey WHEN 0 THEN 'scudi di lire 7' WHEN 1 THEN 'ducati' WHEN 2 THEN 'fiorini' WHEN 3 THEN 'pezze' ELSE 'scudi di lire 7' END")]),
    "economic_activity": ("part", [("ec_activity_id", "p_partkey"), ("activity", "concat(p_type, CASE WHEN p_partkey % 3 = 0 THEN ' e negozio' ELSE '' END)")]),
}


def _shown(expression: str, engine: str) -> str:
    while (at := expression.find("{day:")) >= 0:
        end = expression.index("}", at)
        expression = expression[:at] + _DAY[engine].format(expression[at + 5 : end]) + expression[end + 1 :]
    return expression if engine == "spark" else expression.replace("AS STRING", "AS VARCHAR")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; only the columns that a query uses are read."""
    source, columns = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return df.selectExpr(*(f"{_shown(e, 'spark')} AS {c}" for c, e in columns))


class Archive:
    """The views of one directory as attributes; live_* leaves out soft-deleted rows."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("live_"):
            return load(*self._at, name[5:]).where("is_deleted = 0")
        return load(*self._at, name)


def with_views(sql: str) -> str:
    """The query with the views it names as common table expressions, for DuckDB."""
    used = [n for n in VIEWS if n in sql]
    views = []
    for n in used:
        source, columns = VIEWS[n]
        views.append(f"{n} AS (SELECT {', '.join(f'{_shown(e, "duckdb")} AS {c}' for c, e in columns)} FROM {source})")
    head, own = "WITH ", sql
    if sql.lstrip().upper().startswith("WITH "):
        own = sql.lstrip()[5:]
        return head + ", ".join(views) + ", " + own
    return head + ", ".join(views) + " " + own
