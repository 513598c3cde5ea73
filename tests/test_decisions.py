"""Links, proposals, shares, points and currencies on literal cases."""

import pytest
from pyspark.sql import functions as F


def _select(spark, rows, status="matched_high_confidence", combined=False, several=False, numbers=()):
    from spindle.operators.decisions import select_links

    schema = "entry_id long, rank int, row_id string, db_table string, contract_id long, main_contract_id long, sub_type string, score double, signals array<string>, conflicts array<string>, strength double, ratio double, folio_relation string, word_coverage_in_db double, phrase int, fields int"
    base = {"entry_id": 1, "db_table": "sub_contract", "contract_id": None, "main_contract_id": None, "sub_type": None, "score": 90.0, "signals": [], "conflicts": [], "strength": 0.6, "ratio": 0.5, "folio_relation": None, "word_coverage_in_db": 0.0, "phrase": 0, "fields": 0}
    c = spark.createDataFrame([base | {"rank": k, "row_id": f"r{k}"} | r for k, r in enumerate(rows, 1)], schema)
    e = spark.createDataFrame([(1, status, combined, several, list(numbers))], "entry_id long, status string, combined boolean, several boolean, numbers array<long>")
    return [(r.row_id, r.role, r.needs_review) for r in select_links(c, e).orderBy("ordinal").collect()]


def test_links(spark):
    assert _select(spark, [{}]) == [("r1", "primary", False)]
    assert _select(spark, [{"score": 50.0}]) == []
    assert _select(spark, [{"score": 50.0}], "matched_candidate") == [("r1", "primary", True)]
    # siblings: the one that the entry numbers, else the one that is far more alike, else all; one primary is one to one
    two = [{"main_contract_id": 7, "contract_id": 1}, {"main_contract_id": 7, "contract_id": 2}]
    assert _select(spark, two, numbers=[2]) == [("r2", "primary", False), ("r1", "alternative", True)]
    assert _select(spark, [two[0], two[1] | {"ratio": 0.8}]) == [("r2", "primary", False), ("r1", "alternative", True)]
    assert _select(spark, two) == [("r1", "primary", True), ("r2", "primary", True)]
    # another act of its own needs a number
    act = {"db_table": "contract"}
    assert _select(spark, [{}, act]) == [("r1", "primary", False)]
    assert [r[0] for r in _select(spark, [{}, act | {"signals": ["contract_id_exact"]}])] == ["r1", "r2"]
    # a text of several acts takes strong seconds, which come last
    assert [r[0] for r in _select(spark, [{"score": 70.0}, {"score": 95.0}], several=True)] == ["r2", "r1"]
    # another date is tolerated for a label of several acts
    late = {"conflicts": ["registration_date_differs"]}
    assert _select(spark, [late, late]) == [] and len(_select(spark, [late, late], combined=True)) == 2


def test_proposals(spark):
    from spindle.operators.decisions import proposal_states

    p = spark.createDataFrame([(k, "a", "b" if k == 5 else None if k == 6 else "a") for k in range(1, 7)], "proposal_id int, before string, live string")
    log = [(1, "reject", 1), (1, "approve", 2), (2, "apply", 1), (2, "approve", 2), (3, "approve", 1), (3, "apply", 2), (3, "revert", 3), (3, "apply", 4), (5, "approve", 1), (5, "apply", 2), (6, "approve", 1), (6, "apply", 2)]
    got = proposal_states(p, spark.createDataFrame(log, "proposal_id int, action string, seq int"))
    assert dict(got.select("proposal_id", "status").collect()) == {1: "rejected", 2: "approved", 3: "reverted", 4: "proposed", 5: "approved", 6: "approved"}


def test_points(spark):
    from spindle.operators.decisions import sized_points, within_radius

    p = spark.createDataFrame([(1, 0.0, 0.0), (2, -3.0, 4.0), (3, 5.1, 0.0), (4, 9.9, 9.9)], "point_id int, x double, y double")
    assert sorted(map(tuple, within_radius(p.withColumnRenamed("point_id", "asked_id"), p, 5.0).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 4)]
    assert sized_points(spark.createDataFrame([], "n long")).count() == 0
    assert sized_points(spark.createDataFrame([(0,)], "n long")).first()["size"] == 0.0


@pytest.mark.parametrize(
    "name, signature",
    [
        ("ducati 7 lire 10 soldi", "ducato · lira=7 soldo=10"),
        ("lire 3 4 soldi", "lira · ?=3 soldo=4"),
        ("scudi fiorentini e ducati", "scudo · fiorentina per:ducato"),
        ("fiorini di grossi di banco", "fiorino · §grosso · banco"),
        ("pezze da 8¾ reali di Livorno", "pezza · reale=83/4 · livorno"),
        ("Scudò d’oro sole", "scudo · oro sol"),
        ("moneta", "moneta"),
        (" - ", None),
        (None, None),
    ],
)
def test_currencies(spark, name, signature):
    from spindle.functions.currency import currency_signature

    assert spark.createDataFrame([(name,)], "c string").select(currency_signature(F.col("c")).alias("s")).first()["s"] == signature
