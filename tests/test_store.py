from pyspark.sql import functions as F

from riskweave.operators.validate import route_dlq
from riskweave.sources import messages, store


def test_unique_insert(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("c", 4), (None, 5)], "transaction_id string, n int")
    old = spark.createDataFrame([("b",)], "transaction_id string")
    assert sorted(map(tuple, store.insert_unique(new, old, order=["n"]).collect())) == [("a", 1), ("c", 4)]


def test_lookup_honours_expiry_and_last_write(spark):
    puts = spark.createDataFrame([("k", 1, 1, 10, 20), ("k", 2, 2, 10, 20), ("k", 3, 3, 15, 17)], "key string, value int, seq int, put_ts long, expires_at long")
    probes = spark.createDataFrame([("k", t) for t in (9, 10, 14, 15, 17, 30)] + [("x", 12)], "key string, probe_ts long")
    out = {(r["key"], r["probe_ts"]): r["value"] for r in store.kv_lookup(probes, puts).collect()}
    assert out == {("k", 9): None, ("k", 10): 2, ("k", 14): 2, ("k", 15): 3, ("k", 17): None, ("k", 30): None, ("x", 12): None}
    assert tuple(store.kv_latest(puts).first()) == ("k", 3, 15, 17)


def test_jitter_only_lengthens(spark):
    out = spark.range(500).select(store.jitter_ttl(F.lit(100), 0.1, 3).alias("t"), store.jitter_ttl(F.lit(0), 0.1, 3).alias("z"))
    low, high, zero = out.agg(F.min("t"), F.max("t"), F.min("z")).first()
    assert low >= 100 and 100 < high <= 110 and zero == 1


def test_repeated_batch_replaces_itself(spark, tmp_path):
    write = store.append_store(str(tmp_path / "s"))
    batch = spark.sql("SELECT 'a' AS transaction_id, timestamp'2024-01-05 10:00:00' AS recorded_at")
    write(batch, 0)
    write(batch, 0)
    write(batch.withColumn("recorded_at", F.col("recorded_at") - F.expr("INTERVAL 200 DAYS")), 1)
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 2
    kept = store.retain(stored, F.lit("2024-01-06").cast("timestamp"))
    assert kept.count() == 1
    assert "day" in kept._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_recent_and_latest(spark):
    df = spark.range(20).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("transaction_id"), F.timestamp_seconds("id").alias("recorded_at"))
    assert [r["transaction_id"] for r in store.recent_by(df, "k", 1, 2).collect()] == ["19", "16"]
    assert store.latest_per(df, "k", 2).count() == 6


def test_malformed_message_and_envelope(spark):
    raw = spark.createDataFrame([(b'{"transaction_id":"t","amount":"x"}',), (b"no",), (None,), (b'{"transaction_id":"u","geolocation":{"lat":1.5}}',)], "value binary")
    out = messages.parse_txn(raw).collect()
    assert [r["transaction_id"] for r in out] == ["t", None, None, "u"] and out[0]["amount"] is None and out[3]["geolocation"]["lat"] == 1.5
    env = messages.envelope(spark.createDataFrame([("m", "é"), (None, "b")], "message_id string, t string")).collect()
    assert env[0]["key"] == "m" and env[0]["value"] == '{"message_id":"m","t":"é"}' and env[0]["bytes"] == len(env[0]["value"].encode())
    assert len(env[1]["key"]) == 36


def test_null_verdict_is_a_dead_letter(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    good, dead = route_dlq(df, F.col("ok"), F.lit("why"))
    assert [r["id"] for r in good.collect()] == [1]
    assert sorted(r["id"] for r in dead.where("dlq_reason = 'why' AND dlq_ts > 0").collect()) == [2, 3]


def test_a_look_up_reads_one_bucket_and_expired_days_are_gone(spark, tmp_path):
    rows = spark.range(400).select(
        F.concat(F.lit("k"), F.col("id") % 40).alias("token"), F.format_string("t%03d", "id").alias("transaction_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3_600).alias("recorded_at"),
    )
    path = str(tmp_path / "table")
    stored = store.write_table(rows, "bucketed_store", path, "token", 8)
    found = store.recent_by(stored, "token", "k7", 5)
    assert [r["transaction_id"] for r in found.collect()] == ["t367", "t327", "t287", "t247", "t207"]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan shows the buckets
    try:
        plan = store.recent_by(spark.table("bucketed_store"), "token", "k7", 5)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan
    days = sorted(p.name[4:] for p in (tmp_path / "table").glob("day=*"))
    assert len(list((tmp_path / "table" / f"day={days[3]}").glob("*.parquet"))) <= 8  # one file a bucket
    gone = store.drop_days(spark, path, days[10])
    assert gone == days[:10] and sorted(p.name[4:] for p in (tmp_path / "table").glob("day=*")) == days[10:]
    kept = store.retain(spark.read.parquet(path), F.lit(days[10]).cast("timestamp"), 0)
    assert kept.count() == spark.read.parquet(path).count() - spark.read.parquet(path).where(F.col("recorded_at") <= F.lit(days[10]).cast("timestamp")).count()
    spark.sql("DROP TABLE bucketed_store")


def test_feature_job_publishes_the_fixed_fields(spark):
    import json

    from riskweave.operators import jobs
    from riskweave.schema import VECTOR_FIELDS

    body = lambda i, **more: json.dumps({"transaction_id": f"t{i}", "account_id": "a", "amount": 10.0 * i, "timestamp": f"2024-01-01T00:00:{i:02d}Z", "device_id": f"d{i // 3}", **more})
    texts = [body(i, velocity=0.5, behavior_score=0.1) for i in range(1, 5)] + ["broken", body(9)]
    out = jobs.feature_vectors(spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "value binary")).collect()
    vectors = {r["transaction_id"]: json.loads(r["feature_vector"]) for r in out if r["transaction_id"]}
    assert all(list(v) == [f for f in VECTOR_FIELDS if f in v] for v in vectors.values())
    assert set(vectors["t1"]) == set(VECTOR_FIELDS) and set(VECTOR_FIELDS) - set(vectors["t9"]) == {"velocity", "behavior_score"}
    assert vectors["t3"]["new_device"] == 1 and vectors["t2"]["new_device"] == 0
    assert sum(r["transaction_id"] == "t2" for r in out) == 6  # a row for each window that holds it
    assert [r["window_end"] for r in out if r["transaction_id"] is None] == [None]


def test_one_hot_key_is_written_by_several_tasks(spark, tmp_path):
    """All rows have one key; days still go to different tasks, one file each."""
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("transaction_id"), F.lit("k").alias("token"), F.timestamp_seconds(F.col("id") % 8 * 86_400 + 1_700_000_000).alias("ts")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = store.write_table(rows, "hot_store", str(tmp_path / "table"), "token", 8, "ts")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "table").glob("day=*/*.parquet"))
    assert len(files) == 8 and len({f.name.split("-")[1] for f in files}) > 1
    assert stored.count() == 4000
    spark.sql("DROP TABLE hot_store")


def test_feature_job_parses_a_message_once(spark):
    from riskweave.operators import jobs

    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return bytearray(text.encode())

    body = F.format_string('{"transaction_id":"t%d","account_id":"a%d","amount":1.0,"timestamp":"2024-01-01T00:00:00Z"}', F.col("id"), F.col("id") % 3)
    messages = spark.range(90).select(F.udf(counted, "binary")(body).alias("value"))
    for cut in ({}, {"limit": 10, "rows": 20}):
        read.value = 0
        assert jobs.feature_vectors(messages, **cut).count() == 90 * 6 and read.value == 90
