import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskweave.operators import drift, evaluate, ranks


@pytest.fixture(params=[ranks.SPLIT, 0.5], autouse=True)
def few(request, monkeypatch):
    """Every test runs with one ranking task and with many."""
    monkeypatch.setattr(ranks, "SPLIT", request.param)


def scored(spark, n=500, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(n)]
    return spark.createDataFrame(rows, "y int, p double"), rows


def test_auc_with_ties(spark):
    df, rows = scored(spark)
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df, "y", "p").first()["auc"] == pytest.approx(wins)
    mllib = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(df)
    assert mllib == pytest.approx(wins)


def test_auc_of_one_class_is_null(spark):
    assert evaluate.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, p double"), "y", "p").first()["auc"] is None


@pytest.mark.parametrize("q", [0.0, 0.02, 0.5, 0.7, 0.95, 1.0])
def test_quantile_equals_numpy(spark, q):
    rng = random.Random(4)
    values = [rng.choice([1.0, 2.0, 2.0, rng.random() * 9]) for _ in range(333)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    assert ranks.quantile(df, "v", q).first()["q"] == pytest.approx(np.quantile(values, q))


def test_rank_when_one_value_holds_most_rows(spark):
    df = spark.createDataFrame([(7.0,)] * 300 + [(float(i),) for i in range(7)], "v double")
    got = ranks.order_statistics(df, "v", {"a": (0.02, lambda n: F.lit(6)), "b": (0.5, lambda n: F.lit(7)), "c": (1.0, lambda n: n - 1)}).first()
    assert (got["a"], got["b"], got["c"], got["n"]) == (6.0, 7.0, 7.0, 307)


def test_fences_hold_every_rank(spark):
    values = sorted(random.Random(8).gauss(0, 1) ** 3 for _ in range(4000))
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    for share in (0.001, 0.004, 0.25, 0.9, 0.997, 0.9999):
        got = ranks.order_statistics(df, "v", {"x": (share, lambda n: F.floor(n * share))}).first()
        assert got["x"] == values[int(4000 * share)]


def test_order_statistics_of_nothing(spark):
    got = ranks.order_statistics(spark.createDataFrame([(None,)], "v double"), "v", {"x": (0.5, lambda n: n)}).first()
    assert tuple(got) == (0, None)


def test_sweep_against_brute_force(spark):
    df, rows = scored(spark, 300, 2)
    out = {r["i"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.sweep(df, "y", "p").collect()}
    assert len(out) == 81
    for i, got in out.items():
        t = 0.1 + i * 0.01
        tp = sum(y and p >= t for y, p in rows)
        assert got == (tp, sum((not y) and p >= t for y, p in rows), sum(y for y, _ in rows) - tp)


def test_lowest_threshold_wins_ties(spark):
    df = spark.createDataFrame([(1, 0.95), (0, 0.05)], "y int, p double")
    best = evaluate.optimal_threshold(df, "y", "p").first()
    assert (best["threshold"], best["score"]) == (0.1, 1.0)


def test_report_without_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, pred int")
    out = {r["class"]: (r["precision"], r["recall"], r["f_beta"], r["support"]) for r in evaluate.class_report(df, "y", "pred").collect()}
    assert out[1] == (0.0, 0.0, 0.0, 1) and out[0][:2] == (0.5, 1.0)


def test_scaler_population_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = evaluate.scale(df, evaluate.fit_scaler(df, ["a", "b"]), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def base(spark, edges, expected, name="v"):
    rows = [(name, i, edges[i], edges[i + 1], e) for i, e in enumerate(expected)]
    return spark.createDataFrame(rows, "feature string, bin int, lo double, hi double, expected double")


def test_bin_edges(spark):
    values = [0.0, 0.9, 1.0, 2.0, 99.0, -1.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = drift.bin_counts(df, base(spark, [0.0, 1.0, 2.0, 3.0], [0.2, 0.3, 0.5]))
    assert {r["bin"]: r["n"] for r in out.collect()} == {0: 2, 1: 1, 2: 2}


@pytest.mark.parametrize("observed, low, high", [([25, 25, 25, 25], 0.0, 1e-9), ([10, 15, 35, 40], 0.1, 0.5), ([0, 0, 0, 100], 2.0, 99.0)])
def test_psi(spark, observed, low, high):
    df = spark.createDataFrame([(float(i),) for i, n in enumerate(observed) for _ in range(n)], "v double")
    row = drift.psi(df, base(spark, [0.0, 1.0, 2.0, 3.0, 4.0], [0.25] * 4)).first()
    wanted = sum((max(n / 100, 1e-6) - 0.25) * math.log(max(n / 100, 1e-6) / 0.25) for n in observed)
    assert row["psi"] == pytest.approx(wanted, abs=1e-9) and low <= row["psi"] <= high
    assert row["severity"] == ("ok" if wanted < 0.2 else "warn" if wanted < 0.3 else "crit")


def test_psi_of_nothing_observed(spark):
    df = spark.createDataFrame([], "v double")
    assert drift.psi(df, base(spark, [0.0, 1.0, 2.0], [0.5, 0.5])).first()["psi"] == pytest.approx(2 * (1e-6 - 0.5) * math.log(1e-6 / 0.5))


def test_baseline_file(spark, tmp_path):
    path = tmp_path / "meta.json"
    path.write_text('{"x": 1,\n "drift_baseline": {"a": {"edges": [0, 1, 2], "expected": [0.4, 0.6]}, "bad": {"edges": [0, 1], "expected": [0.4, 0.6]}}}')
    out = drift.load_baseline(spark, str(path)).orderBy("bin").collect()
    assert [tuple(r) for r in out] == [("a", 0, 0.0, 1.0, 0.4), ("a", 1, 1.0, 2.0, 0.6)]
    path.write_text('{"x": 1}')
    assert drift.load_baseline(spark, str(path)).count() == 0


def test_quantiles_of_small_frames(spark):
    """Every size up to 60 and some larger ones, near both ends: the fences must hold the wanted rank."""
    for n in [*range(1, 61, 7), 120, 721, 1500]:
        values = [float((i * 37) % n) for i in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for q in (0.0, 0.02, 0.5, 0.98, 1.0):
            assert ranks.quantile(df, "v", q).first()["q"] == pytest.approx(float(np.quantile(values, q)), abs=1e-9)


def test_nan_is_never_labelled(spark):
    df = spark.createDataFrame([(float(i),) for i in range(120)] + [(float("nan"),), (None,)], "v double")
    out = evaluate.label_by_quantile(df, "v", 0.98).collect()
    assert sorted(r["v"] for r in out if r["label"] == 1) == [117.0, 118.0, 119.0]
