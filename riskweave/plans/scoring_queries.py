"""Scores, decisions, documents and the flagship query."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from riskweave.functions import numbers, privacy
from riskweave.operators import features, graph, policy, scoring
from riskweave.operators.controls import auth_reason
from riskweave.operators.metrics import decision_counts
from riskweave.plans.feature_queries import MOVED, span
from riskweave.plans.registry import query
from riskweave.plans.store_queries import EDGES, edges, nodes
from riskweave.plans.views import COMPONENTS, TX, components, tx, with_sql
from riskweave.sources.messages import envelope
from riskweave.sources.tables import table

# Demonstration keys; jobs take theirs from the cluster's secret store.
TOKEN_KEY = hashlib.sha256(b"token key for queries").digest()
AES_KEY = hashlib.sha256(b"cipher key for queries").digest()


def hmac_sql(message: str, key: bytes = TOKEN_KEY) -> str:
    """DuckDB HMAC-SHA256 as hex: the same two nested hashes over the padded key."""
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


# Light score over features made from raw events.
LIGHT = f"""feats AS (
  SELECT *, avg(amount) OVER {span(86400)} AS avg24, count(*) OVER {span(1800)} AS f30, count(*) OVER {span(86400)} AS t24,
         max(m) OVER {span(3600)} AS moved_1h FROM moved),
light AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    CASE WHEN avg24 > 0 THEN CASE WHEN amount / greatest(1.0::DOUBLE, avg24) > 5 THEN 0.5::DOUBLE WHEN amount / greatest(1.0::DOUBLE, avg24) > 3 THEN 0.3::DOUBLE
      WHEN amount / greatest(1.0::DOUBLE, avg24) > 2 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END
    + 0.2::DOUBLE * ip_risk_score + 0.2::DOUBLE * location_risk_score + 0.1::DOUBLE * vpn_detected + 0.1::DOUBLE * moved_1h
    + CASE WHEN f30 > 20 OR t24 > 200 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)) AS score FROM feats)"""


def light(spark, sf, **options):
    return scoring.light_score(features.model_features(tx(spark, sf)), **options)


@query(
    "m1_light_score",
    with_sql(TX, MOVED, LIGHT, body="SELECT transaction_id, round(score, 6) AS score, CASE WHEN score >= 0.3::DOUBLE THEN 'FRAUD' ELSE 'NORMAL' END AS decision FROM light"),
)
def light_score(spark, sf):
    # 0.3 instead of the served 0.7, which this table never reaches.
    return light(spark, sf, threshold=0.3).select("transaction_id", F.round("score", 6).alias("score"), "decision")


@query(
    "decisions_per_channel",
    with_sql(
        TX, MOVED, LIGHT,
        body="""SELECT CASE WHEN score >= 0.3::DOUBLE THEN 'FRAUD' ELSE 'NORMAL' END AS decision, channel, 'light' AS model_version, count(*) AS n
  FROM light GROUP BY ALL""",
    ),
)
def decisions_per_channel(spark, sf):
    return decision_counts(light(spark, sf, threshold=0.3).withColumn("model_version", F.lit("light")))


BLEND = "(0.7::DOUBLE * tabular + 0.1::DOUBLE * graph + 0.15::DOUBLE * coalesce(autoencoder, 0) + 0.05::DOUBLE * lstm)"


@query("m2_blend", with_sql(TX, COMPONENTS, body=f"SELECT transaction_id, round({BLEND}, 6) AS score FROM components"))
def blend(spark, sf):
    return scoring.blend(components(spark, sf)).select("transaction_id", F.round("score", 6).alias("score"))


@query(
    "m3_blend_present",
    with_sql(
        TX, COMPONENTS,
        body=f"SELECT transaction_id, round({BLEND} / (0.85::DOUBLE + CASE WHEN autoencoder IS NULL THEN 0 ELSE 0.15::DOUBLE END), 6) AS score FROM components",
    ),
)
def blend_present(spark, sf):
    return scoring.blend_present(components(spark, sf)).select("transaction_id", F.round("score", 6).alias("score"))


@query(
    "m4_aggregate_risk",
    with_sql(
        TX, COMPONENTS,
        body="SELECT transaction_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.6::DOUBLE * tabular + 0.3::DOUBLE * graph + 0.1::DOUBLE * ip_risk_score)), 6) AS risk FROM components",
    ),
)
def aggregate_risk(spark, sf):
    risk = scoring.aggregate_risk(F.col("tabular"), F.col("graph"), F.col("ip_risk_score"))
    return components(spark, sf).select("transaction_id", F.round(risk, 6).alias("risk"))


@query("m5_decide", with_sql(TX, COMPONENTS, body="SELECT transaction_id, CASE WHEN tabular >= 0.7::DOUBLE THEN 'FRAUD' ELSE 'NORMAL' END AS decision FROM components"))
def decide(spark, sf):
    return components(spark, sf).select("transaction_id", scoring.decide(F.col("tabular")).alias("decision"))


@query(
    "m6_decide3",
    with_sql(
        TX, COMPONENTS,
        body="""SELECT transaction_id, CASE WHEN tabular >= 0.85::DOUBLE THEN 'block' WHEN tabular >= 0.6::DOUBLE THEN 'review' ELSE 'approve' END AS action
  FROM components""",
    ),
)
def decide3(spark, sf):
    return components(spark, sf).select("transaction_id", scoring.decide3(F.col("tabular")).alias("action"))


@query(
    "m7_anomaly_risk",
    with_sql(TX, body="SELECT transaction_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - ((amount / 100 - 0.5::DOUBLE) + 0.5::DOUBLE) / 2)), 6) AS risk FROM tx"),
)
def anomaly_risk(spark, sf):
    return tx(spark, sf).select("transaction_id", F.round(numbers.anomaly_risk(F.col("amount") / 100 - 0.5), 6).alias("risk"))


@query(
    "m8_recon_risk",
    """SELECT vec_id, round(least(1.0::DOUBLE, sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - x::DOUBLE * 0.9::DOUBLE) * (x::DOUBLE - x::DOUBLE * 0.9::DOUBLE)))) / 5), 5) AS norm_risk,
  round(least(1.0::DOUBLE, 10 * list_sum(list_transform(embedding, lambda x: (x::DOUBLE - x::DOUBLE * 0.9::DOUBLE) * (x::DOUBLE - x::DOUBLE * 0.9::DOUBLE))) / len(embedding)), 5) AS mse_risk FROM embeddings""",
)
def recon_risk(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("xhat", F.transform("embedding", lambda x: x.cast("double") * 0.9))
    x, xhat = F.col("embedding"), F.col("xhat")
    return e.select(
        "vec_id", F.round(numbers.norm_risk(x, xhat), 5).alias("norm_risk"), F.round(numbers.mse_risk(x, xhat), 5).alias("mse_risk")
    )


@query(
    "m9_graph_score",
    with_sql(
        TX, EDGES,
        body="""SELECT event_id, round(CASE WHEN a.embedding IS NULL OR b.embedding IS NULL THEN 0.0::DOUBLE
    ELSE (1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) * 0.5::DOUBLE + 0.5::DOUBLE END, 5) AS graph
  FROM edges LEFT JOIN embeddings a ON a.vec_id = source LEFT JOIN embeddings b ON b.vec_id = target""",
    ),
)
def graph_score(spark, sf):
    return graph.graph_score(edges(spark, sf), nodes(spark, sf)).select("event_id", F.round("graph", 5).alias("graph"))


@query(
    "m10_pair_features",
    with_sql(
        TX, EDGES,
        body="""SELECT event_id, source, target, 192 AS width, round(list_sum(list_transform(list_zip(a.embedding, b.embedding),
    lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 4) AS distance
  FROM edges JOIN embeddings a ON a.vec_id = source JOIN embeddings b ON b.vec_id = target""",
    ),
)
def pair_features(spark, sf):
    pairs = graph.lookup_pairs(edges(spark, sf), nodes(spark, sf)).where("src_vec IS NOT NULL AND dst_vec IS NOT NULL")
    as_double = lambda c: F.col(c).cast("array<double>")
    f = pairs.withColumn("f", numbers.pair_features(as_double("src_vec"), as_double("dst_vec")))
    distance = F.aggregate(F.slice("f", 129, 64), F.lit(0.0), lambda acc, v: acc + v)
    return f.select("event_id", "source", "target", F.size("f").alias("width"), F.round(distance, 4).alias("distance"))


def partly_scored(spark, sf):
    """Transactions whose primary score is missing for a fifth of them."""
    made = features.model_features(tx(spark, sf))
    return made.withColumn("score", F.when(F.col("k") % 5 != 0, F.least(F.lit(1.0), F.col("amount") / 200.0)))


FALLBACK = """fallback AS (
  SELECT transaction_id, account_id, k % 5 = 0 AS degraded, CASE WHEN k % 5 <> 0 THEN least(1.0::DOUBLE, amount / 200) ELSE score END AS final FROM light)"""


@query(
    "m11_score_with_fallback",
    with_sql(
        TX, MOVED, LIGHT, FALLBACK,
        body="""SELECT transaction_id, degraded, round(final, 6) AS score, CASE WHEN final >= 0.7::DOUBLE THEN 'FRAUD' ELSE 'NORMAL' END AS decision
  FROM fallback""",
    ),
)
def score_with_fallback(spark, sf):
    scored, _ = scoring.score_with_fallback(partly_scored(spark, sf))
    return scored.select("transaction_id", "degraded", F.round("score", 6).alias("score"), "decision")


@query(
    "m11_deferred_messages",
    with_sql(
        TX,
        body="""SELECT transaction_id AS key, concat('{"message_id":"', transaction_id, '","type":"deferred_prediction","transaction_id":"', transaction_id,
  '","account_id":"', account_id, '"}') AS value FROM tx WHERE k % 5 = 0""",
    ),
)
def deferred_messages(spark, sf):
    _, deferred = scoring.score_with_fallback(partly_scored(spark, sf))
    fields = deferred.select(F.col("transaction_id").alias("message_id"), "type", "transaction_id", "account_id")
    return envelope(fields).select("key", "value")


@query(
    "s15_rescore_deferred",
    with_sql(
        TX, MOVED, LIGHT,
        body="""SELECT transaction_id, account_id, round(score, 6) AS score, CASE WHEN score >= 0.7::DOUBLE THEN 'FRAUD' ELSE 'NORMAL' END AS decision,
  true AS deferred FROM light WHERE k % 5 = 0""",
    ),
)
def rescore_deferred(spark, sf):
    _, deferred = scoring.score_with_fallback(partly_scored(spark, sf))
    out = scoring.rescore_deferred(deferred, scoring.light_score, ["transaction_id", "account_id"])
    return out.select("transaction_id", "account_id", F.round("result.score", 6).alias("score"), "result.decision", "deferred")


def with_breakdown(spark, sf):
    c = scoring.blend(components(spark, sf))
    names = ["tabular", "graph", "autoencoder", "lstm"]
    present = [F.struct(F.lit(n).alias("key"), F.when((F.col("k") % 7 != 0) | (F.lit(n) != "tabular"), F.col(n)).alias("value")) for n in names]
    kept = F.filter(F.array(*present), lambda e: e["value"].isNotNull())
    return c.withColumns({"breakdown": F.map_from_entries(kept), "decision": scoring.decide(F.col("score"))})


@query(
    "p6_to_response",
    with_sql(
        TX, COMPONENTS,
        body=f"""SELECT transaction_id, round({BLEND}, 6) AS score, CASE WHEN {BLEND} >= 0.7::DOUBLE THEN 'FRAUD' ELSE 'NORMAL' END AS decision,
  round(CASE WHEN k % 7 <> 0 THEN tabular ELSE {BLEND} END, 6) AS supervised, round(coalesce(autoencoder, 0), 6) AS anomaly, round(lstm, 6) AS deep FROM components""",
    ),
)
def to_response(spark, sf):
    r = scoring.to_response(with_breakdown(spark, sf))
    part = lambda n: F.round(f"risk_breakdown.{n}", 6)
    return r.select(
        "transaction_id", F.round("fraud_probability", 6).alias("score"), "decision", part("supervised_probability").alias("supervised"),
        part("anomaly_risk").alias("anomaly"), part("deep_reconstruction_risk").alias("deep"),
    )


@query(
    "p7_audit_doc",
    with_sql(
        TX, COMPONENTS,
        body=f"""SELECT transaction_id, round({BLEND}, 6) AS fraud_probability, 0.7::DOUBLE AS threshold, channel, {BLEND} >= 0.7::DOUBLE AS is_fraud,
  {hmac_sql('account_id')} AS customer_token, {hmac_sql('device_id')} AS device_token FROM components""",
    ),
)
def audit_doc(spark, sf):
    doc = scoring.audit_doc(with_breakdown(spark, sf), TOKEN_KEY, AES_KEY)
    return doc.select(
        "transaction_id", F.round("fraud_probability", 6).alias("fraud_probability"), "threshold", "channel", "is_fraud", "customer_token", "device_token"
    )


# Tokens, ciphers, signatures.
@query("f11_pii_token", with_sql(TX, body=f"SELECT transaction_id, {hmac_sql('account_id')} AS token FROM tx"))
def pii_token(spark, sf):
    return tx(spark, sf).select("transaction_id", privacy.pii_token(F.col("account_id"), TOKEN_KEY).alias("token"))


@query("f12_encrypt_pii", "SELECT c_custkey, c_name AS decrypted, CAST(length(c_name) + 28 AS INTEGER) AS bytes FROM customer")
def encrypt_pii(spark, sf):
    c = table(spark, sf, "customer").withColumn("enc", privacy.encrypt_pii(F.col("c_name"), AES_KEY))
    return c.select("c_custkey", privacy.decrypt_pii(F.col("enc"), AES_KEY).alias("decrypted"), F.octet_length(F.unbase64("enc")).alias("bytes"))


SIGNED = "concat('POST|/', channel, '|', CAST(ts_long AS VARCHAR), '|', CASE WHEN k % 3 = 0 THEN '' ELSE device_id END, '|', transaction_id)"


def signed(spark, sf):
    t = tx(spark, sf)
    nonce = F.when(F.col("k") % 3 != 0, F.col("device_id"))
    path, ts = F.concat(F.lit("/"), "channel"), F.col("ts_long").cast("string")
    signature = privacy.sign(F.lit("POST"), path, ts, F.col("transaction_id"), nonce, TOKEN_KEY)
    return t.withColumns({"signature": signature, "path": path, "nonce": nonce, "claimed": ts})


@query(
    "f15_verify_signed",
    with_sql(TX, body=f"SELECT transaction_id, to_base64(unhex({hmac_sql(SIGNED)})) AS signature, k % 10 <> 0 AS verified FROM tx"),
)
def verify_signed(spark, sf):
    s = signed(spark, sf)
    body = F.when(F.col("k") % 10 == 0, F.concat("transaction_id", F.lit("x"))).otherwise(F.col("transaction_id"))
    again = privacy.sign(F.lit("POST"), F.col("path"), F.col("claimed"), body, F.col("nonce"), TOKEN_KEY)
    return s.select("transaction_id", "signature", (again == F.col("signature")).alias("verified"))


def claimed_time():
    k = F.col("k")
    return F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, "soon").otherwise((F.col("ts_long") - k * 2).cast("string"))


SKEW = """CASE WHEN k % 11 = 0 THEN 'missing_signature' WHEN k % 11 = 1 THEN 'invalid_timestamp' WHEN k * 2 > 60 THEN 'signature_expired' END"""


@query("f19_skew_reason", with_sql(TX, body=f"SELECT transaction_id, {SKEW} AS reason FROM tx"))
def skew_reason(spark, sf):
    return tx(spark, sf).select("transaction_id", privacy.skew_reason(F.col("ts_long"), claimed_time()).alias("reason"))


def url_base64(value):
    return F.regexp_replace(F.translate(privacy.base64_text(value), "+/", "-_"), "=+$", "")


@query(
    "f21_check_token",
    with_sql(
        TX,
        body="""SELECT transaction_id, CASE WHEN k % 12 = 0 THEN 'malformed' WHEN k % 12 = 1 THEN 'algorithm' WHEN k % 12 = 2 THEN 'signature'
    WHEN k % 12 = 3 THEN 'missing_claim' WHEN k % 12 = 4 THEN 'expired' WHEN k % 12 = 5 THEN 'not_yet_valid' WHEN k % 12 = 6 THEN 'audience'
    WHEN k % 12 = 7 THEN 'issuer' END AS reason FROM tx""",
    ),
)
def check_token(spark, sf):
    """One claim token per event, eight of twelve kinds with one planted defect each."""
    t = tx(spark, sf).withColumn("kind", F.col("k") % 12)
    kind, now = F.col("kind"), F.col("ts_long")
    header = F.when(kind == 1, '{"alg":"none"}').otherwise('{"alg":"HS256","typ":"JWT"}')
    claims = F.to_json(
        F.struct(
            F.when(kind == 7, "other").otherwise("risk").alias("iss"),
            F.when(kind == 6, "other").otherwise("api").alias("aud"),
            F.when(kind == 5, now + 60).otherwise(now - 60).alias("iat"),
            F.when(kind == 3, F.lit(None)).when(kind == 4, now - 1).otherwise(now + 900).alias("exp"),
            F.col("account_id").alias("sub"),
        )
    )
    text = F.concat(url_base64(header.cast("binary")), F.lit("."), url_base64(claims.cast("binary")))
    mac = url_base64(privacy.hmac_sha256(text, TOKEN_KEY))
    token = F.when(kind == 0, "abc").when(kind == 2, F.concat(text, F.lit(".AAAA"))).otherwise(F.concat(text, F.lit("."), mac))
    made = t.select("transaction_id", "ts_long", token.alias("token"))
    return made.select("transaction_id", privacy.token_reason(F.col("token"), now, TOKEN_KEY, "risk", "api").alias("reason"))


LINES = "list_filter(string_split(text, chr(10))[2:], lambda s: length(s) > 0)"
DENY, ALLOW = ("(" + "|".join(names) + ")" for names in (policy.Policy().deny_licenses, policy.Policy().allow_licenses))
COPYLEFT = "(" + policy.COPYLEFT.removeprefix("(?i)") + ")"


@query(
    "f22_policy_flag",
    f"""WITH d AS (SELECT doc_id, source AS name, coalesce(string_split(text, chr(10))[1], '') AS license, coalesce({LINES}, CAST([] AS VARCHAR[])) AS lines FROM documents),
v AS (SELECT *, list_filter(list_transform(lines, lambda s: CASE WHEN regexp_matches(s, '{DENY}', 'i') THEN 1 WHEN regexp_matches(s, '{ALLOW}', 'i') THEN 0 END),
    lambda x: x IS NOT NULL)[1] AS first_line FROM d)
SELECT doc_id, CASE WHEN regexp_matches(name, '^wiki', 'i') THEN false WHEN first_line IS NOT NULL THEN first_line = 1
  WHEN length(license) < 64 AND regexp_matches(license, '{DENY}', 'i') THEN true
  WHEN length(license) < 64 AND regexp_matches(license, '{ALLOW}', 'i') THEN false
  WHEN len(lines) > 0 THEN len(list_filter(lines, lambda s: regexp_matches(s, '{COPYLEFT}', 'i') AND NOT regexp_matches(s, 'lesser general public license', 'i'))) > 0
  WHEN length(license) > 0 AND length(license) < 64 AND regexp_matches(license, '{COPYLEFT}', 'i') AND NOT regexp_matches(license, 'lesser general public license', 'i') THEN true
  ELSE length(license) = 0 END AS blocked FROM v""",
)
def policy_flag(spark, sf):
    """The first line is the license text, the others are classifiers."""
    d = table(spark, sf, "documents")
    parts = F.split("text", "\n")
    lines = F.filter(F.slice(parts, 2, F.size(parts)), lambda s: F.length(s) > 0)
    rows = d.select(
        "doc_id",
        F.col("source").alias("name"),
        F.get(parts, F.lit(0)).alias("license"),
        F.coalesce(lines, F.array().cast("array<string>")).alias("classifiers"),
    )
    return policy.policy_flag(rows, policy.Policy(ignore_packages=["^wiki"], block_unknown=True)).select("doc_id", "blocked")


@query(
    "f23_auth_reason",
    with_sql(
        TX,
        body=f"""SELECT transaction_id, CASE WHEN k % 13 = 0 THEN 'missing_bearer' WHEN k % 17 = 0 THEN 'jwt_invalid'
    WHEN {SKEW} IS NOT NULL THEN {SKEW} WHEN k % 10 = 0 THEN 'invalid_signature' WHEN k % 8 = 0 THEN 'invalid_device' END AS reason FROM tx""",
    ),
)
def auth_outcome(spark, sf):
    s = signed(spark, sf)
    k = F.col("k")
    s = s.withColumns(
        {
            "bearer": F.when(k % 13 != 0, "Bearer x"),
            "token_fault": F.when(k % 17 == 0, "signature"),
            "skew": privacy.skew_reason(F.col("ts_long"), claimed_time()),
            "device": F.when(k % 8 == 0, "dev-1").otherwise(F.col("device_id")),
        }
    )
    body = F.when(k % 10 == 0, F.concat("transaction_id", F.lit("x"))).otherwise(F.col("transaction_id"))
    again = privacy.sign(F.lit("POST"), F.col("path"), F.col("claimed"), body, F.col("nonce"), TOKEN_KEY)
    steps = {
        "missing_bearer": F.col("bearer").isNull() | ~F.col("bearer").startswith("Bearer "),
        "jwt_invalid": F.col("token_fault").isNotNull(),
        "missing_signature": F.col("skew") == "missing_signature",
        "invalid_timestamp": F.col("skew") == "invalid_timestamp",
        "signature_expired": F.col("skew") == "signature_expired",
        "invalid_signature": again != F.col("signature"),
        "invalid_device": ~privacy.valid_device(F.col("device")),
    }
    return s.select("transaction_id", auth_reason(steps).alias("reason"))


@query("f18_log_contains", "SELECT doc_id, length(text) AS n FROM documents WHERE contains(text, 'de')")
def log_contains(spark, sf):
    from riskweave.operators.logs import log_contains as contains

    return contains(table(spark, sf, "documents"), "text", "de").select("doc_id", F.length("text").cast("bigint").alias("n"))
