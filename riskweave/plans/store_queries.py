"""Sources, stores, key-value lookups, joins, sets and top-k queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskweave.operators import drift, graph, logs, metrics, ml
from riskweave.operators.features import ORDER
from riskweave.operators.validate import route_dlq
from riskweave.plans.registry import query
from riskweave.plans.views import REQUESTS, TX, cut_all, requests, tx, with_sql
from riskweave.session import shared_dir
from riskweave.sources import messages, store
from riskweave.sources.tables import load_training, table


@query(
    "s2_parse_txn",
    with_sql(
        TX,
        body="""SELECT CASE WHEN k % 9 = 0 THEN NULL ELSE transaction_id END AS transaction_id,
  CASE WHEN k % 9 = 0 THEN NULL ELSE account_id END AS account_id, CASE WHEN k % 9 = 0 THEN NULL ELSE amount END AS amount,
  CASE WHEN k % 9 = 0 THEN NULL ELSE ts_long END AS ts_long, CASE WHEN k % 9 = 0 THEN NULL ELSE k::DOUBLE END AS lat,
  CASE WHEN k % 9 = 0 THEN NULL ELSE vpn_detected END AS is_night FROM tx""",
    ),
)
def parse_txn(spark, sf):
    t = tx(spark, sf)
    geo = F.struct(F.col("k").cast("double").alias("lat"), F.lit(0.5).alias("lon"))
    body = F.to_json(
        F.struct("transaction_id", "account_id", "amount", F.col("ts").alias("timestamp"), geo.alias("geolocation"), F.col("vpn_detected").alias("is_night"))
    )
    raw = t.select(F.when(F.col("k") % 9 == 0, F.lit("{broken")).otherwise(body).cast("binary").alias("value"))
    return messages.parse_txn(raw).select(
        "transaction_id", "account_id", "amount", F.unix_timestamp("timestamp").alias("ts_long"), F.col("geolocation.lat").alias("lat"), "is_night"
    )


@query(
    "s3_load_training",
    """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
  WHERE o_totalprice > 100000 GROUP BY o_orderstatus""",
)
def training_scan(spark, sf):
    rows = load_training(spark, f"{sf}/orders.parquet", ["o_orderstatus", "o_totalprice"]).where("o_totalprice > 100000")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def enveloped(spark, sf):
    e = tx(spark, sf).select(F.col("transaction_id").alias("message_id"), "account_id", "channel", "k")
    return messages.envelope(e)


@query(
    "s5_envelope",
    with_sql(
        TX,
        body="""SELECT transaction_id AS key, concat('{"message_id":"', transaction_id, '","account_id":"', account_id, '","channel":"', channel,
  '","k":', k, '}') AS value, CAST(length(concat('{"message_id":"', transaction_id, '","account_id":"', account_id, '","channel":"', channel,
  '","k":', k, '}')) AS INTEGER) AS bytes FROM tx""",
    ),
)
def envelope(spark, sf):
    return enveloped(spark, sf)


@query(
    "s6_route_dlq",
    with_sql(
        TX,
        body="""SELECT transaction_id, CASE WHEN amount >= 2 THEN 'transactions' ELSE 'transactions.dlq' END AS topic,
  CASE WHEN amount >= 2 THEN NULL ELSE 'amount below 2' END AS dlq_reason, CASE WHEN amount >= 2 THEN NULL ELSE ts_long::DOUBLE END AS dlq_ts FROM tx""",
    ),
)
def dead_letters(spark, sf):
    t = tx(spark, sf)
    good, dead = route_dlq(t, F.col("amount") >= 2, F.lit("amount below 2"), F.col("ts_long").cast("double"))
    good = good.select("transaction_id", F.lit("transactions").alias("topic"))
    dead = dead.select("transaction_id", F.lit("transactions.dlq").alias("topic"), "dlq_reason", "dlq_ts")
    return good.unionByName(dead, allowMissingColumns=True)


@query(
    "s9_insert_unique",
    with_sql(
        TX,
        body="""SELECT key, min(event_id) AS event_id FROM (SELECT transaction_id AS key, event_id FROM tx
    UNION ALL SELECT transaction_id, event_id + 1000000000000 FROM tx) n
  WHERE key NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) GROUP BY key""",
    ),
)
def insert_unique(spark, sf):
    """Every transaction arrives twice; ids that are customer keys count as stored."""
    t = tx(spark, sf)
    new = t.select(F.col("transaction_id").alias("key"), "event_id")
    new = new.unionByName(new.withColumn("event_id", F.col("event_id") + 1_000_000_000_000))
    old = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return store.insert_unique(new, old, "key", ["event_id"])


@query(
    "s10_retain",
    """SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 15552000 SECOND""",
)
def retain(spark, sf):
    o = table(spark, sf, "orders")
    newest = o.agg(F.max("o_orderdate").alias("as_of"))  # one row
    dated = o.crossJoin(F.broadcast(newest))
    return store.retain(dated, F.col("as_of"), ts="o_orderdate").select("o_orderkey")


@query(
    "s11_recent_by",
    with_sql(TX, body="SELECT transaction_id, ts_long FROM tx WHERE device_id = 'dev1' ORDER BY ts DESC, transaction_id DESC LIMIT 50"),
)
def recent_by(spark, sf):
    return store.recent_by(tx(spark, sf), "device_id", "dev1", 50, ts="ts").select("transaction_id", "ts_long")


BUCKETS, KEPT_DAYS = 8, 12


@query(
    "s11_recent_by_bucketed",
    with_sql(TX, body="SELECT transaction_id, ts_long FROM tx WHERE device_id = 'dev1' ORDER BY ts DESC, transaction_id DESC LIMIT 50"),
)
def recent_by_bucketed(spark, sf):
    """From a store of day folders bucketed by the key."""
    name = f"riskweave_store_{uuid.uuid4().hex}"
    stored = store.write_table(tx(spark, sf), name, f"{shared_dir(spark)}/riskweave-tables/{name}", "device_id", BUCKETS, "ts")
    return store.recent_by(stored, "device_id", "dev1", 50, ts="ts").select("transaction_id", "ts_long")


@query(
    "s10_retain_days",
    with_sql(TX, body=f"SELECT transaction_id FROM tx WHERE ts > (SELECT max(ts) FROM tx) - INTERVAL {KEPT_DAYS * 86_400} SECOND"),
)
def retain_days(spark, sf):
    """Expired day folders go whole; the day that the bound cuts is filtered."""
    path = f"{shared_dir(spark)}/riskweave-tables/{uuid.uuid4().hex}"
    t = tx(spark, sf)
    t.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    newest = t.agg(F.max("ts").alias("as_of"))  # one row
    bound = newest.select((F.col("as_of") - F.make_dt_interval(secs=F.lit(KEPT_DAYS * 86_400))).cast("date").cast("string")).first()[0]
    if bound is not None:
        store.drop_days(spark, path, bound)
    kept = spark.read.schema(t.withColumn("day", F.to_date("ts")).schema).parquet(path).crossJoin(F.broadcast(newest))
    return store.retain(kept, F.col("as_of"), KEPT_DAYS * 86_400, "ts").select("transaction_id")


PUTS = """puts AS (SELECT account_id AS key, k AS value, event_id AS seq, ts_long AS put_ts, ts_long + CASE WHEN k % 2 = 0 THEN 3600 ELSE 600 END AS expires_at
  FROM tx),
probes AS (SELECT account_id AS key, event_id, ts_long + k * 40 AS probe_ts FROM tx)"""


def puts(spark, sf):
    t = tx(spark, sf)
    made = t.select(F.col("account_id").alias("key"), F.col("k").alias("value"), F.col("event_id").alias("seq"), F.col("ts_long").alias("put_ts"))
    ttl = F.when(F.col("value") % 2 == 0, store.FEATURE_TTL).otherwise(store.RISK_TTL)
    return store.with_expiry(made, ttl)


@query(
    "s12_kv_latest",
    with_sql(
        TX, PUTS,
        body="SELECT key, value, put_ts, expires_at FROM puts QUALIFY row_number() OVER (PARTITION BY key ORDER BY put_ts DESC, seq DESC) = 1",
    ),
)
def kv_latest(spark, sf):
    return store.kv_latest(puts(spark, sf))


@query("s13_jitter_ttl", with_sql(TX, body="SELECT event_id, true AS in_range FROM tx"))
def jitter_ttl(spark, sf):
    t = tx(spark, sf).withColumn("ttl", store.jitter_ttl(F.lit(600), 0.1, seed=7))
    return t.select("event_id", F.col("ttl").between(600, 660).alias("in_range"))


KV_SQL = with_sql(
    TX, PUTS,
    body="""SELECT event_id, CASE WHEN probe_ts < expires_at THEN value END AS value FROM probes ASOF LEFT JOIN
  (SELECT * FROM puts QUALIFY row_number() OVER (PARTITION BY key, put_ts ORDER BY seq DESC) = 1) puts
  ON probes.key = puts.key AND probes.probe_ts >= puts.put_ts""",
)


def lookups(spark, sf, **cut):
    probe = (F.col("ts_long") + F.col("k") * 40).alias("probe_ts")  # up to an hour after the account's own write
    probes = tx(spark, sf).select(F.col("account_id").alias("key"), "event_id", probe)
    return store.kv_lookup(probes, puts(spark, sf), **cut).select("event_id", "value")


@query("s14_kv_lookup", KV_SQL)
def kv_lookup(spark, sf):
    return lookups(spark, sf)


@query("s14_kv_lookup_cut_keys", KV_SQL)
def kv_lookup_cut(spark, sf):
    return lookups(spark, sf, **cut_all(spark, sf))


def baseline_docs(spark, sf):
    """One baseline object per event: a valid feature, one without edges, and one whose lengths do not fit."""
    k = F.col("k").cast("double")
    good = F.struct(F.array(F.lit(0.0), k + 1, k + 2).alias("edges"), F.array(F.lit(0.25), F.lit(0.75)).alias("expected"))
    short = F.struct(F.array(F.lit(0.0), k + 1).alias("edges"), F.array(F.lit(0.5), F.lit(0.5)).alias("expected"))
    bare = F.struct(F.array(F.lit(1.0)).alias("expected"))
    body = F.struct(good.alias("good"), short.alias("short"), bare.alias("bare"))
    return tx(spark, sf).select("event_id", F.to_json(body).alias("baseline"))


@query(
    "s16_load_baseline",
    with_sql(
        TX,
        body="""SELECT event_id, 'good' AS feature, CAST(i AS INTEGER) AS bin, CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE k + 1.0::DOUBLE END AS lo,
  k + 1.0::DOUBLE + i AS hi, CASE WHEN i = 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS expected FROM tx, range(2) r(i)""",
    ),
)
def load_baseline(spark, sf):
    return drift.parse_baseline(baseline_docs(spark, sf), "baseline", ["event_id"])


@query("s17_stamp_ingest", with_sql(TX, body="SELECT transaction_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, true AS received FROM tx"))
def stamp_ingest(spark, sf):
    out = messages.stamp_ingest(tx(spark, sf))
    return out.select("transaction_id", "timestamp", F.col("received_at").isNotNull().alias("received"))


# Joins.
EDGES = "edges AS (SELECT event_id, user_id AS source, CAST(k * 7 AS BIGINT) AS target FROM tx)"


def edges(spark, sf):
    return tx(spark, sf).select("event_id", F.col("user_id").alias("source"), (F.col("k") * 7).cast("bigint").alias("target"))


def nodes(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(
    "j3_lookup_pairs",
    with_sql(
        TX, EDGES,
        body="""SELECT event_id, source, target, round(a.embedding[1]::DOUBLE, 5) AS src_first, round(b.embedding[64]::DOUBLE, 5) AS dst_last
  FROM edges LEFT JOIN embeddings a ON a.vec_id = source LEFT JOIN embeddings b ON b.vec_id = target""",
    ),
)
def lookup_pairs(spark, sf):
    found = graph.lookup_pairs(edges(spark, sf), nodes(spark, sf))
    first, last = F.get("src_vec", F.lit(0)).cast("double"), F.get("dst_vec", F.lit(63)).cast("double")
    return found.select("event_id", "source", "target", F.round(first, 5).alias("src_first"), F.round(last, 5).alias("dst_last"))


MANIFEST = """manifest AS (SELECT doc_id, sha256(text) AS hash FROM documents),
actual AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN concat(text, 'x') ELSE text END) AS hash FROM documents WHERE doc_id % 25 <> 1)"""


@query(
    "j6_audit_hashes",
    with_sql(
        MANIFEST,
        body="""SELECT m.doc_id, CASE WHEN a.hash IS NULL THEN 'missing' ELSE 'mismatch' END AS reason
  FROM manifest m LEFT JOIN actual a USING (doc_id) WHERE a.hash IS DISTINCT FROM m.hash""",
    ),
)
def audit_hashes(spark, sf):
    d = table(spark, sf, "documents")
    altered = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    manifest = d.select("doc_id", F.sha2("text", 256).alias("hash"))
    actual = d.where("doc_id % 25 <> 1").select("doc_id", F.sha2(altered, 256).alias("hash"))
    return logs.audit_hashes(manifest, actual, "doc_id")


@query(
    "j7_correlate",
    with_sql(
        TX, REQUESTS,
        body="""SELECT correlation_id, left_lines, first_ts, right_lines, last_ts FROM
  (SELECT correlation_id, count(*) AS left_lines, min(ts_long) AS first_ts FROM requests WHERE service = 'a' GROUP BY 1) a JOIN
  (SELECT (correlation_id + k % 2) AS correlation_id, count(*) AS right_lines, max(ts_long) AS last_ts FROM requests WHERE service = 'b' GROUP BY 1) b
  USING (correlation_id)""",
    ),
)
def correlate(spark, sf):
    r = requests(spark, sf)
    right = r.where("service = 'b'").withColumn("correlation_id", F.col("correlation_id") + F.col("k") % 2)
    return logs.correlate(r.where("service = 'a'"), right)


# Top-k and sampling.
@query(
    "l1_query_logs",
    with_sql(
        TX, REQUESTS,
        body="""SELECT event_id, path, status FROM requests WHERE service = 'a' AND path = '/view'
  AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50""",
    ),
)
def query_logs(spark, sf):
    start, end = F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    return logs.query_logs(requests(spark, sf), {"service": "a", "path": "/view"}, start, end, 50).select("event_id", "path", "status")


@query(
    "l2_latest_per",
    with_sql(
        TX,
        body="""SELECT account_id, transaction_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, transaction_id DESC) AS INTEGER) AS rank
  FROM tx QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, transaction_id DESC) <= 3""",
    ),
)
def latest_per(spark, sf):
    return store.latest_per(tx(spark, sf), "account_id", 3, ts=ORDER[0], tie=ORDER[1]).select("account_id", "transaction_id", "rank")


@query("l3_background", "SELECT vec_id, label FROM embeddings ORDER BY md5(concat('11:', CAST(vec_id AS VARCHAR))), vec_id LIMIT 100")
def background(spark, sf):
    return ml.background(table(spark, sf, "embeddings"), 100, "vec_id", seed=11).select("vec_id", "label")


# Sets.
@query(
    "u1_missing_series",
    with_sql(
        TX,
        body="""SELECT DISTINCT concat('series_', channel, '_', CAST(k AS VARCHAR)) AS name FROM tx
  EXCEPT SELECT DISTINCT concat('series_', channel, '_', CAST(k AS VARCHAR)) FROM tx WHERE amount > 60""",
    ),
)
def missing_series(spark, sf):
    t = tx(spark, sf).withColumn("name", F.concat(F.lit("series_"), "channel", F.lit("_"), F.col("k").cast("string")))
    return metrics.missing_series(t, t.where("amount > 60"))


@query(
    "u2_series_or",
    with_sql(
        TX,
        body="""SELECT account_id, 'left' AS side, sum(k) AS value FROM tx WHERE channel = 'error' GROUP BY account_id, device_id
  UNION ALL SELECT account_id, 'right', sum(k) FROM tx WHERE channel = 'view' AND concat(account_id, device_id) NOT IN
  (SELECT concat(account_id, device_id) FROM tx WHERE channel = 'error') GROUP BY account_id, device_id""",
    ).replace("sum(k)", "CAST(sum(k) AS BIGINT)"),
)
def series_or(spark, sf):
    t = tx(spark, sf)

    def side(name, cond):
        return t.where(cond).groupBy("account_id", "device_id").agg(F.lit(name).alias("side"), F.sum("k").alias("value"))

    both = metrics.series_or(side("left", "channel = 'error'"), side("right", "channel = 'view'"), ["account_id", "device_id"])
    return both.select("account_id", "side", "value")


@query(
    "u3_has_roles",
    with_sql(TX, body="SELECT transaction_id, k % 2 = 0 AND k % 3 = 0 AS admin, k % 2 = 0 AS reader FROM tx"),
)
def has_roles(spark, sf):
    k = F.col("k")
    roles = F.array_compact(F.array(F.when(k % 2 == 0, "read"), F.when(k % 3 == 0, "write"), F.lit("login")))
    t = tx(spark, sf).withColumn("roles", roles)
    return t.select(
        "transaction_id",
        metrics.has_roles(F.col("roles"), ["read", "write"]).alias("admin"),
        metrics.has_roles(F.col("roles"), ["read"]).alias("reader"),
    )
