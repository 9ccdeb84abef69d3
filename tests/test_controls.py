"""Keyed controls: hand-computed cards, hot-key parity, chains."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import controls, transfer

ORDER = ["now", "id"]


def run(step, rows):
    state, out = None, []
    for row in rows:
        state, made = step(state, row)
        out.append(made if len(made) > 1 else made[0])
    return out


def test_rejected_repeat_does_not_extend():
    assert run(controls.ttl_step(10), [(0,), (5,), (9.9,), (10,), (19,), (21,)]) == [True, False, False, True, False, True]


def test_replay_reasons():
    rows = [(0, 100.0), (50, 100.0), (100, 100.0), (101, 300.0), (102, 300.0)]
    assert run(controls.replay_step(), rows) == ["ok", "replay", "expired", "ok", "replay"]


def test_bucket_blocks_after_capacity_and_keeps_last():
    out = run(controls.bucket_step(2, 60), [(0.0,), (0.1,), (0.2,), (0.9,), (1.2,)])
    # The blocked rows leave `last` at 0.1, so one second after that a token is back.
    assert [a for a, _ in out] == [True, True, False, False, True]


def test_bucket_105_calls():
    allowed = [a for a, _ in run(controls.bucket_step(100, 50), [(i * 0.001,) for i in range(105)])]
    assert allowed.count(True) == 100 and allowed[-1] is False


def test_breaker_opens_refuses_and_recovers():
    rows = [(t, True) for t in range(5)] + [(10, True), (34.5, False), (35, False), (36, True)]
    out = run(controls.breaker_step(5, 60, 30), rows)
    assert out[4] == ("open", True)
    assert out[5] == ("open", False)  # refused, not recorded
    assert out[6] == ("closed", False)  # open until 34
    assert out[8] == ("closed", False)


def test_breaker_retrips_on_one_failure_after_reopening():
    out = run(controls.breaker_step(5, 60, 30), [(t, True) for t in range(5)] + [(40, True)])
    assert out[5] == ("open", True)


def test_drift_step_decays_at_window():
    step = controls.drift_step({"f": [0.0, 1.0, 2.0]}, {"f": [0.5, 0.5]}, window=10)
    state = None
    for i in range(10):
        state, _ = step(state, ("f", 0.5))
    assert state == [9.0, 9.0, 0.0]
    before = list(state)
    state, _ = step(state, ("f", float("nan")))
    assert state[1:] == [int(c * 0.9) for c in before[1:]]


def table(spark, n=400, seed=9):
    rng = random.Random(seed)
    rows, now = [], 0.0
    for i in range(n):
        now += rng.choice([0.0, 0.5, 3.0, 40.0])
        rows.append((i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(15)}", now, rng.random() < 0.6))
    df = spark.createDataFrame(rows, "id long, key string, now double, failed boolean")
    return df.withColumn("ts_long", F.floor("now"))


@pytest.mark.parametrize(
    "make",
    [
        lambda df, **c: controls.dedup_ttl(df, ["key"], ORDER, 60, **c),
        lambda df, **c: controls.token_bucket(df, ["key"], ORDER, 3, 1.5, **c),
        lambda df, **c: controls.breaker(df, ["key"], ORDER, 3, 60, 45, **c),
    ],
)
def test_cut_key_equals_sequential(spark, make):
    df = table(spark)
    plain = sorted(map(tuple, make(df).collect()))
    cut = make(df, limit=30, rows=20)
    assert sorted(map(tuple, cut.select(*make(df).columns).collect())) == plain


@pytest.mark.parametrize(
    "make",
    [
        lambda df, **c: controls.dedup_ttl(df, ["key"], ORDER, 600, **c),
        lambda df, **c: controls.token_bucket(df, ["key"], ORDER, 3, 1.5, **c),
        lambda df, **c: controls.replay_guard(df.withColumn("exp", F.col("now") + F.col("id") % 900), "key", ORDER, **c),
    ],
)
def test_dense_hot_key_in_64_slices_takes_logarithmic_passes(spark, monkeypatch, make):
    """A row every 7 seconds: each slice's end depends on its start, so no slice knows its entry by itself."""
    written, write = [], transfer.write_table
    monkeypatch.setattr(transfer, "write_table", lambda df: written.append(1) or write(df))
    df = spark.range(1600).select("id", F.lit("hot").alias("key"), (F.col("id") * 7.0).alias("now"))
    cut = make(df, limit=30, rows=25)
    assert len(written) == 3 + 6  # bounds, tables, entries; six doublings
    assert cut.orderBy("id").collect() == make(df).orderBy("id").collect()


def test_rows_out_of_order_nulls_and_lone_slices(spark):
    rows = [(i, "hot", now, True) for i, now in enumerate([5.0, None, 1.0, float("nan"), 1.0, 70.0, 3.0, None, 64.0, 66.0])]
    df = spark.createDataFrame(rows, "id long, key string, now double, failed boolean")
    for make in (lambda **c: controls.dedup_ttl(df, ["key"], ["id"], 60, **c), lambda **c: controls.token_bucket(df, ["key"], ["id"], 1, 1.0, **c)):
        assert make(limit=1, rows=1).drop("now").orderBy("id").collect() == make().drop("now").orderBy("id").collect()
    accepted = {r["id"]: r["accepted"] for r in controls.dedup_ttl(df, ["key"], ["id"], 60).collect()}
    assert accepted == {0: False, 1: None, 2: True, 3: None, 4: False, 5: False, 6: False, 7: None, 8: True, 9: False}


@pytest.mark.parametrize("cut", [{}, {"limit": 20, "rows": 37}])
@pytest.mark.parametrize("window", [1, 3, 10, 64])
def test_running_drift_equals_the_fold(spark, cut, window):
    edges, expected = {"f": [0.0, 1.0, 2.0, 3.0], "g": [10.0, 20.0, 30.0]}, {"f": [0.2, 0.3, 0.5], "g": [0.5, 0.5]}
    rng = random.Random(window)
    rows = [(i, rng.choice("fg"), "m" if rng.random() < 0.8 else "n", rng.choice([-1.0, 0.0, 0.5, 1.0, 2.5, 3.0, 25.0, 99.0, None, float("nan")])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, feature string, monitor string, value double")
    out = controls.running_drift(df, edges, expected, ["feature", "monitor"], ["id"], window=window, **cut)
    got = {r["id"]: (r["psi"], r["alert"]) for r in out.collect()}
    step, states = controls.drift_step(edges, expected, window), {}
    for i, feature, monitor, value in rows:
        states[feature, monitor], (psi, alert) = step(states.get((feature, monitor)), (feature, value))
        assert got[i][0] == pytest.approx(psi, abs=1e-12) and got[i][1] == alert, i


def test_running_drift_of_an_unknown_feature_is_null(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, None, 1.0)], "id long, feature string, value double")
    out = controls.running_drift(df, {"f": [0.0, 1.0]}, {"f": [1.0]}, ["feature"], ["id"]).collect()
    assert [(r["psi"], r["alert"]) for r in out] == [(None, None)] * 2


def test_fold_keeps_nulls_and_large_integers(spark):
    big = 2**53
    rows = [(0, None, 0.0, big + 1, 1.5), (1, None, 1.0, None, float("nan")), (2, big, 2.0, 1, None), (3, big + 1, 3.0, 2, 0.0), (4, big, 4.0, 3, 0.0), (5, big, None, 4, 0.0)]
    df = spark.createDataFrame(rows, "id long, key long, now double, other long, x double").coalesce(1)
    for cut in ({}, {"limit": 1, "rows": 1}):
        out = {r["id"]: r for r in controls.dedup_ttl(df, ["key"], ["now", "id"], 60, **cut).collect()}
        assert [out[i]["key"] for i in range(6)] == [r[1] for r in rows]
        assert [out[i]["other"] for i in range(6)] == [r[3] for r in rows]
        assert out[1]["x"] != out[1]["x"] and out[2]["x"] is None
        assert [out[i]["accepted"] for i in range(6)] == [True, False, True, True, False, None]


def test_replay_guard_without_id(spark):
    df = spark.createDataFrame([(1, None, 1.0, 9.0), (2, "j", 1.0, 9.0), (3, "j", 2.0, 9.0)], "id long, jti string, now double, exp double")
    out = {r["id"]: r["reason"] for r in controls.replay_guard(df, "jti", ORDER).collect()}
    assert out == {1: "missing_jti", 2: "ok", 3: "replay"}


def test_hash_chain_and_tampering(spark):
    rows = [(1, i, t) for i, t in enumerate(["a", "b", "c"])] + [(2, 0, "a")]
    df = spark.createDataFrame(rows, "k int, n int, text string")
    out = {(r["k"], r["n"]): r["chain"] for r in controls.hash_chain(df, ["k"], ["n"], "text").collect()}
    last = b""
    for i, text in enumerate(["a", "b", "c"]):
        last = hashlib.sha256(last + text.encode()).digest()
        assert out[(1, i)] == last.hex()
    changed = df.withColumn("text", F.when(F.col("n") == 1, "x").otherwise(F.col("text")))
    again = {(r["k"], r["n"]): r["chain"] for r in controls.hash_chain(changed, ["k"], ["n"], "text").collect()}
    assert again[(1, 0)] == out[(1, 0)] and again[(1, 1)] != out[(1, 1)] and again[(1, 2)] != out[(1, 2)]
