import math

import pytest
from pyspark.sql import functions as F

from riskweave.operators import alerts, logs, metrics

INF = float("inf")


def test_quantile_inside_infinite_and_empty(spark):
    rows = [("a", 10.0, 2), ("a", 20.0, 4), ("a", INF, 4), ("b", 10.0, 1), ("b", 20.0, 1), ("b", INF, 10), ("c", 10.0, 0), ("c", INF, 0)]
    h = spark.createDataFrame(rows, "g string, le double, value long")
    out = {r["g"]: r["quantile"] for r in metrics.histogram_quantile(h, 0.75, ["g"]).collect()}
    assert out == {"a": 15.0, "b": 20.0}


def test_histogram_edges_are_inclusive(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (5.0,), (9.0,), (None,)], "v double").withColumn("g", F.lit("x"))
    out = metrics.histogram(df, "v", [1, 5], ["g"]).orderBy("le").collect()
    assert [(r["le"], r["value"], r["sum"], r["count"]) for r in out] == [(1.0, 1, 16.5, 4), (5.0, 3, 16.5, 4), (INF, 4, 16.5, 4)]


def samples(spark, values, name="c"):
    rows = [(name, "s", t, i, float(v)) for i, (t, v) in enumerate(values)]
    return spark.createDataFrame(rows, "name string, series string, ts_long long, seq long, value double")


def test_counter_reset_counts_from_zero(spark):
    s = samples(spark, [(0, 5), (10, 9), (20, 2), (30, 3), (100, 3)])
    out = metrics.counter_increase(s, ["name"], 30).orderBy("ts_long")
    assert [r["increase"] for r in out.collect()] == [0.0, 4.0, 6.0, 7.0, 0.0]


def test_error_ratio_without_requests_is_bounded(spark):
    df = spark.createDataFrame([("a", 1, 500), ("a", 2, 200), ("a", 50, 200)], "service string, ts_long long, status int")
    assert [r["error_ratio"] for r in metrics.error_ratio(df, ["service"], 10).orderBy("ts_long").collect()] == [1.0, 0.5, 0.0]


@pytest.mark.parametrize("cut", [{}, {"limit": 2, "rows": 2}])
def test_alert_holds_before_firing(spark, cut):
    s = samples(spark, [(0, 9), (60, 9), (120, 9), (180, 1), (240, 9), (400, 9)], "lag")
    rule = alerts.Rule("High", "lag", "value", ">", 5, 120)
    out = alerts.eval_alerts(s, [rule], **cut).orderBy("ts_long").collect()
    assert [r["state"] for r in out] == ["pending", "pending", "firing", "ok", "pending", "firing"]
    assert [r["since"] for r in out] == [0, 0, 0, None, 240, 240]


def test_alert_names_are_matched_whole(spark):
    s = samples(spark, [(0, 1)], "psi_feature_x").unionByName(samples(spark, [(0, 1)], "other_psi_feature_x"))
    rules = [alerts.Rule("W", "psi_feature_.*", "value", ">", 0.2, 0), alerts.Rule("C", "psi_feature_.*", "value", ">", 0.3, 0)]
    out = alerts.eval_alerts(s, rules).collect()
    assert sorted((r["rule"], r["name"], r["state"]) for r in out) == [("C", "psi_feature_x", "firing"), ("W", "psi_feature_x", "firing")]


def test_all_served_rules_run(spark):
    gauge = samples(spark, [(0, 1), (130, 1)], "safe_mode_state").withColumn("le", F.lit(None).cast("double"))
    out = alerts.eval_alerts(gauge).where("ts_long = 130").collect()
    assert [(r["rule"], r["state"]) for r in out] == [("SafeModeActive", "firing")]


def test_rules_on_labels_and_ratios(spark):
    rows = [
        ("requests_total", "a", 0, 0, 0.0, "200", None), ("requests_total", "a", 100, 1, 9000.0, "200", None),
        ("fraud_backend_requests_total", "b", 0, 0, 0.0, "503", None), ("fraud_backend_requests_total", "b", 100, 1, 9.0, "503", None),
        ("redis_memory_used_bytes", "r", 0, 0, 95.0, None, None), ("redis_total_system_memory_bytes", "r", 0, 0, 100.0, None, None),
    ]
    s = spark.createDataFrame(rows, "name string, series string, ts_long long, seq long, value double, status string, le double")
    out = {(r["rule"], r["ts_long"]): (r["x"], r["state"]) for r in alerts.eval_alerts(s).collect()}
    assert out == {("BackendErrorsSpike", 0): (0.0, "ok"), ("BackendErrorsSpike", 100): (9.0, "pending"), ("RedisHighMemory", 0): (0.95, "pending")}


def test_quantile_rule_adds_up_series(spark):
    rows = []
    for series, slow in (("a", 0.0), ("b", 100.0)):
        for le, part in ((50.0, 100.0 - slow), (100.0, 100.0), (float("inf"), 100.0)):
            rows += [("request_latency_ms_bucket", series, 0, 0, 0.0, le), ("request_latency_ms_bucket", series, 60, 1, part, le)]
    s = spark.createDataFrame(rows, "name string, series string, ts_long long, seq long, value double, le double")
    out = [(r["series"], r["x"], r["state"]) for r in alerts.eval_alerts(s).where("ts_long = 60").collect()]
    assert out == [("", pytest.approx(95.0), "pending")]


@pytest.mark.parametrize("late", [0, 1, 20])
def test_quantile_rule_adds_up_series_scraped_apart(spark, late):
    """A fast and a slow instance of equal traffic; the second one is scraped ``late`` seconds after the first."""
    rows, seq = [], 0
    for at in range(0, 241, 60):
        for series, slow, shift in (("a", 0.0, 0), ("b", 1.0, late)):
            for le, share in ((50.0, 1.0 - slow), (100.0, 1.0), (float("inf"), 1.0)):
                rows.append(("request_latency_ms_bucket", series, at + shift, seq, share * at, le))
            seq += 1
    rows.append(("request_latency_ms_bucket", "gone", 0, seq, 1e9, 50.0))  # one sample: no growth, and edges of its own
    s = spark.createDataFrame(rows, "name string, series string, ts_long long, seq long, value double, le double")
    for cut in ({}, {"limit": 1, "rows": 3}):
        out = alerts.eval_alerts(s, **cut).where("ts_long >= 120").collect()
        assert len(out) >= 5 and {r["series"] for r in out} == {""}
        # half of all requests under 50 ms: the 95th percentile lies nine tenths into the next bucket
        exact = [r["x"] for r in out if late == 0 or r["ts_long"] % 60]
        assert exact == [pytest.approx(95.0)] * len(exact)
        assert {r["state"] for r in out} <= {"pending", "firing"} and max(r["x"] for r in out) < 97


def test_run_summary_floor_index(spark):
    rows = [(i, 200 if i else 500, "FRAUD" if i % 2 else "NORMAL", float(v)) for i, v in enumerate([4, 1, 3, 2])] + [(10, 200, None, None)]
    out = metrics.run_summary(spark.createDataFrame(rows, "ts_long long, status int, decision string, duration_ms double")).first()
    assert (out["total"], out["ok"], out["fraud"], out["errors"], out["req_per_sec"]) == (5, 4, 2, 1, 0.5)
    assert (out["latency_avg_ms"], out["latency_p50_ms"], out["latency_p95_ms"]) == (2.5, 3.0, 4.0)


def test_tally_keeps_empty_classes(spark):
    df = spark.createDataFrame([(200, "FRAUD"), (500, "FRAUD"), (200, None)], "status int, decision string")
    assert {r["outcome"]: r["n"] for r in metrics.tally(df).collect()} == {"FRAUD": 1, "NORMAL": 0, "ERROR": 2}


def test_health_sets_and_roles(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, True)], "snapshot int, ok boolean")
    assert {r["snapshot"]: r["status"] for r in metrics.health_rollup(df).collect()} == {1: "degraded", 2: "ok"}
    left = spark.createDataFrame([("a", 1)], "l string, v int")
    right = spark.createDataFrame([("a", 2), ("b", 3)], "l string, v int")
    assert sorted(map(tuple, metrics.series_or(left, right, ["l"]).collect())) == [("a", 1), ("b", 3)]
    roles = spark.createDataFrame([(["x", "y"],), ([],), (None,)], "r array<string>")
    assert [r[0] for r in roles.select(metrics.has_roles(F.col("r"), ["x"])).collect()] == [True, False, False]


def test_log_line(spark):
    line = '{"ts":"t","level":"info","service":"s","correlation_id":null,"route":"/r","logger":"l","message":"m","score":0.5,"extra":{"a":1}}'
    row = logs.parse_log(spark.createDataFrame([(line,), ("broken",)], "l string"), "l").collect()
    assert (row[0]["message"], row[0]["score"], row[0]["labels"], row[0]["rest"]) == ("m", "0.5", {"service": "s", "route": "/r"}, {"extra": '{"a":1}'})
    assert row[1]["message"] is None


def test_manifest_of_files(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    (tmp_path / "b").write_text("two")
    found = logs.file_hashes(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    import hashlib

    manifest = spark.createDataFrame([(n, hashlib.sha256(t).hexdigest()) for n, t in (("a", b"one"), ("b", b"2"), ("c", b"x"))], "path string, hash string")
    assert sorted(map(tuple, logs.audit_hashes(manifest, found, "path").collect())) == [("b", "mismatch"), ("c", "missing")]


def test_cpu_and_memory(spark):
    rows = [("i", c, t, t, float(t) / 2) for c in (0, 1) for t in (0, 10, 20)]
    s = spark.createDataFrame(rows, "instance string, cpu int, ts_long long, seq long, value double")
    out = metrics.cpu_pct(s, ["instance"], 20).where("ts_long = 20").first()
    assert math.isclose(out["cpu_pct"], 50.0)
    m = spark.createDataFrame([(25.0, 100.0)], "available double, total double")
    assert metrics.mem_pct(m).first()["mem_pct"] == 75.0


@pytest.mark.parametrize("cut", [{}, {"limit": 10, "rows": 50}])
def test_rules_compute_an_expression_once(spark, cut):
    """The rows judged feed several steps, which must not each compute the rules from the samples again."""
    read = spark.sparkContext.accumulator(0)

    def counted(value):
        read.add(1)
        return value

    long = spark.range(100).select(F.lit("lat").alias("name"), F.lit("all").alias("series"), (F.col("id") * 10).alias("ts_long"), F.col("id").alias("seq"), F.lit(float("inf")).alias("le"), F.udf(counted, "double")(F.col("id") * 2.0).alias("value"))
    for kind, rows, most in (("value", 100, 100), ("quantile", 99, 400)):  # nothing has grown at the first scrape
        read.value = 0
        out = alerts.eval_alerts(long, [alerts.Rule("R", "lat", kind, ">", 5, 60)], **cut)
        assert len(out.collect()) == rows and read.value <= most
