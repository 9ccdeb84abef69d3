import pytest
from pyspark.sql import functions as F

from riskweave.operators import scoring, validate
from riskweave.operators.graph import graph_score
from riskweave.schema import MODEL_FEATURES

COLUMNS = [
    "transaction_amount", "avg_transaction_amount_24h", "ip_risk_score", "location_risk_score", "vpn_detected", "login_ip_changed_last_hour",
    "transaction_frequency_30min", "transactions_last_24h",
]


@pytest.mark.parametrize(
    "row, expected",
    [
        ((100.0, 0.0, 0.0, 0.0, 0, 0, 0, 0), 0.0),  # no history, no ratio
        ((500.0, 100.0, 0.0, 0.0, 0, 0, 0, 0), 0.3),  # exactly 5 is not above 5
        ((500.1, 100.0, 0.0, 0.0, 0, 0, 0, 0), 0.5),
        ((300.0, 100.0, 0.0, 0.0, 0, 0, 0, 0), 0.15),
        ((200.0, 100.0, 0.0, 0.0, 0, 0, 0, 0), 0.0),
        ((2.5, 0.1, 0.0, 0.0, 0, 0, 0, 0), 0.15),  # divisor at least 1
        ((1.0, 1.0, 1.0, 1.0, 1, 1, 21, 0), 0.7),
        ((1.0, 1.0, 0.0, 0.0, 0, 0, 20, 200), 0.0),
        ((1.0, 1.0, 0.0, 0.0, 0, 0, 0, 201), 0.1),
        ((900.0, 100.0, 1.0, 1.0, 1, 1, 30, 0), 1.0),  # clipped
    ],
)
def test_light_score_cards(spark, row, expected):
    out = scoring.light_score(spark.createDataFrame([row], COLUMNS)).first()
    assert out["score"] == pytest.approx(expected)


def test_decisions_at_the_threshold(spark):
    df = spark.createDataFrame([(0.7,), (0.6999,), (0.6,), (0.85,)], "s double")
    out = df.select(scoring.decide(F.col("s")), scoring.decide3(F.col("s"))).collect()
    assert [tuple(r) for r in out] == [("FRAUD", "review"), ("NORMAL", "review"), ("NORMAL", "review"), ("FRAUD", "block")]


def test_blends_differ_when_a_component_is_missing(spark):
    df = spark.createDataFrame([(0.5, None, 1.0, None), (None, None, None, None)], "tabular double, graph double, autoencoder double, lstm double")
    over_all = [r["score"] for r in scoring.blend(df).collect()]
    present = [r["score"] for r in scoring.blend_present(df).collect()]
    assert over_all == pytest.approx([0.5 * 0.7 + 0.15, 0.0])
    assert present == pytest.approx([(0.5 * 0.7 + 0.15) / 0.85, 0.0])


def test_fallback_marks_and_defers(spark):
    row = (1.0, 1.0, 1.0, 1.0, 1, 1, 21, 0)
    df = spark.createDataFrame([row + (0.9,), row + (None,)], COLUMNS + ["score"])
    scored, deferred = scoring.score_with_fallback(df)
    assert sorted((r["degraded"], round(r["score"], 6), r["decision"]) for r in scored.collect()) == [(False, 0.9, "FRAUD"), (True, 0.7, "FRAUD")]
    assert [r["type"] for r in deferred.collect()] == ["deferred_prediction"]


def test_graph_score_missing_and_zero_nodes(spark):
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, [-1.0, 0.0])], "id long, vector array<double>")
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 9), (9, 1), (1, 5), (1, 2)], "source long, target long")
    out = sorted((r["source"], r["target"], r["graph"]) for r in graph_score(edges, nodes).collect())
    assert out == [(1, 2, 0.5), (1, 2, 0.5), (1, 3, 1.0), (1, 4, 0.0), (1, 5, 1.5), (1, 9, 0.0), (9, 1, 0.0)]


def test_validation_boundaries(spark):
    rules = validate.range_rules({"hour": (0, 23), "risk": (0, 1)})
    df = spark.createDataFrame([(0, 0.0), (23, 1.0), (24, 0.5), (None, -0.1)], "hour int, risk double")
    assert [r["violations"] for r in validate.validate(df, rules).collect()] == [[], [], ["hour"], ["hour", "risk"]]
    good, bad = validate.split_valid(df, rules)
    assert (good.count(), bad.count()) == (2, 2)


def test_amount_must_be_positive_number(spark):
    df = spark.createDataFrame([("t", "a", 0.0), ("t", "a", float("nan")), ("t", "a", None), ("t", "a", 0.01)], "transaction_id string, account_id string, amount double")
    assert [r["violations"] for r in validate.validate(df, validate.transaction_rules()).collect()] == [["amount"]] * 3 + [[]]


def test_model_frame_and_vector(spark):
    df = spark.createDataFrame([(1, 2.0, "standard")], "id int, transaction_amount double, customer_segment string")
    made = validate.model_frame(df, MODEL_FEATURES, ["id"])
    assert made.columns == ["id", *MODEL_FEATURES]
    assert made.first()["hour_of_day"] is None
    assert validate.vectorize(df, MODEL_FEATURES).first()["vector"] == [2.0] + [0.0] * 13


def test_unknown_fields(spark):
    df = spark.createDataFrame([('{"a":1,"z":2,"b":3}',), ('{"a":1}',), ("broken",)], "j string")
    assert [r["extra_fields"] for r in validate.reject_extra(df, "j", ["a"]).collect()] == [["b", "z"], [], None]
