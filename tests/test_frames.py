"""Hot-key forms against plain windows and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import asof, features, frames

KEY = ["account_id"]


def rows_of(n, seed, hot_share=0.4, crowd=0):
    """Random transactions; one account holds ``hot_share`` of the rows, ``crowd`` of them in a single second."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = rng.random() < hot_share or i < crowd
        second = 500 if i < crowd else rng.randrange(0, 4000)
        amount = None if rng.random() < 0.05 else round(rng.uniform(1, 100), 2)
        out.append(("hot" if hot else f"a{rng.randrange(20)}", f"t{i:05d}", second, amount, f"d{rng.randrange(3)}", f"r{rng.randrange(8)}", f"ip{rng.randrange(3)}"))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "account_id string, transaction_id string, ts_long long, amount double, device_id string, receiver_id string, ip string")
    return df.withColumn("ts", F.timestamp_seconds("ts_long"))


def same_rows(left, right, columns):
    a, b = (sorted(map(tuple, df.select(*columns).collect())) for df in (left, right))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[0] == y[0]
        assert list(x[1:]) == pytest.approx(list(y[1:]), abs=1e-6)


@pytest.mark.parametrize("crowd", [0, 120])
def test_vector_features_cut_equals_plain(spark, crowd):
    df = frame(spark, rows_of(600, 1, crowd=crowd))
    columns = ["transaction_id", "rolling_mean", "rolling_std", "amount_z", "new_device", "rolling_amount_5m", "amount_ratio"]
    plain = features.stream_vector_features(df).fillna(-1)
    cut = features.stream_vector_features(df, limit=100, rows=20).fillna(-1)
    same_rows(cut, plain, columns)


def test_model_features_cut_equals_plain(spark):
    df = frame(spark, rows_of(500, 2, crowd=60))
    columns = [
        "transaction_id", "time_since_last_tx", "transaction_frequency_30min", "transactions_last_24h", "avg_transaction_amount_24h",
        "login_ip_changed_last_hour", "unique_receivers_24h",
    ]
    plain = features.model_features(df, receivers=True).fillna(-1)
    cut = features.model_features(df, receivers=True, limit=100, rows=20).fillna(-1)
    same_rows(cut, plain, columns)


def test_trailing_lengths_without_a_common_pane(spark):
    rows = rows_of(200, 8, hot_share=0.7, crowd=10)
    wanted = {f"n{s}": ("count", None, s) for s in (1, 907, 3607)} | {"m": ("max", "amount", 907)}
    got = {r["transaction_id"]: r for r in frames.over_trailing(frame(spark, rows), KEY, "ts_long", wanted).collect()}
    for key, tid, at, *_ in rows:
        for s in (1, 907, 3607):
            inside = [r[3] for r in rows if r[0] == key and at - s <= r[2] <= at]
            assert got[tid][f"n{s}"] == len(inside)
            if s == 907:
                assert got[tid]["m"] == max((a for a in inside if a is not None), default=None)


def test_panes_bound_what_a_frame_adds_up():
    assert [frames.pane_seconds(x) for x in ([300], [1800, 3600, 86_400], [7], [3607], [1, 86_400])] == [300, 600, 7, 600, None]


@pytest.mark.parametrize("seconds", [7, 60, 900, 907])
def test_trailing_against_brute_force(spark, seconds):
    rows = rows_of(300, 3, hot_share=1.0, crowd=30)
    wanted = {"s": ("sum", "amount", seconds), "n": ("count", None, seconds), "m": ("max", "amount", seconds), "a": ("avg", "amount", seconds)}
    out = frames.over_trailing(frame(spark, rows), KEY, "ts_long", wanted, limit=10, rows=25)
    got = {r["transaction_id"]: (r["s"], r["n"], r["m"], r["a"]) for r in out.collect()}
    for _, tid, at, *_ in rows:
        inside = [r for r in rows if at - seconds <= r[2] <= at]
        amounts = [r[3] for r in inside if r[3] is not None]
        s, n, m, a = got[tid]
        assert n == len(inside)
        assert m == (max(amounts) if amounts else None)
        assert s == pytest.approx(sum(amounts)) if amounts else s is None
        assert a == pytest.approx(sum(amounts) / len(amounts)) if amounts else a is None


@pytest.mark.parametrize("seconds", [5, 300])
def test_distinct_against_brute_force(spark, seconds):
    rows = [r[:5] + (None if i % 17 == 0 else r[5],) + r[6:] for i, r in enumerate(rows_of(250, 4, hot_share=1.0))]
    out = frames.distinct_trailing(frame(spark, rows), KEY, "ts_long", "receiver_id", seconds, "n", limit=10, rows=20)
    got = {r["transaction_id"]: r["n"] for r in out.collect()}
    for _, tid, at, *_ in rows:
        assert got[tid] == len({r[5] for r in rows if r[5] and at - seconds <= r[2] <= at})


def test_first_row_and_empty_frame(spark):
    df = frame(spark, [("a", "t1", 10, 5.0, "d1", "r1", "ip1")])
    row = features.stream_vector_features(df).first()
    assert (row["rolling_std"], row["amount_z"], row["new_device"], row["rolling_amount_5m"]) == (0.0, 0.0, 0, 5.0)
    assert features.stream_vector_features(df.where("false")).count() == 0


def test_asof_cut_equals_plain_and_respects_time(spark):
    facts = spark.createDataFrame([("hot", i * 10, float(i)) for i in range(200)] + [("a", 5, 9.0)], "key string, at long, value double")
    probes = spark.createDataFrame([("hot", i) for i in range(0, 2100, 7)] + [("a", 4), ("a", 5), ("b", 1)], "key string, t long")
    plain = asof.asof_join(probes, facts, ["key"], "t", "at", ["value"], "at")
    cut = asof.asof_join(probes, facts, ["key"], "t", "at", ["value"], "at", limit=20, rows=30)
    expected = sorted((k, t, (float(min(t // 10, 199)) if k == "hot" else (9.0 if (k, t) == ("a", 5) else None))) for k, t in probes.collect())
    assert sorted(map(tuple, plain.collect())) == expected
    assert sorted(map(tuple, cut.collect())) == expected


def test_join_stats_fans_out_by_window_only(spark):
    df = frame(spark, rows_of(100, 5, hot_share=1.0))
    joined = asof.join_stats(df, features.window_stats(df))
    assert joined.count() == 600
    assert joined.where("avg_amount IS NULL AND amount IS NOT NULL").count() == 0


def test_null_account_is_kept(spark):
    rows = rows_of(80, 6) + [(None, "tn", 3, 1.0, "d", "r", "ip")]
    assert features.rolling_mean(frame(spark, rows), limit=20, rows=10).count() == 81
