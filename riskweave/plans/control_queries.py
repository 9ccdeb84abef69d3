"""Keyed controls in batch form, hash chains, and model queries."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from riskweave.operators import controls, ml
from riskweave.plans.registry import query
from riskweave.plans.views import TX, cut_all, scored, tx, with_sql
from riskweave.sources.tables import table

ORDER = ["ts", "event_id"]


def stamped(spark, sf):
    """Transactions with fractional seconds ``now`` and the keys the controls use."""
    t = tx(spark, sf)
    return t.withColumns(
        {
            "now": F.unix_micros("ts") / 1e6,
            "idem": F.concat("account_id", "device_id"),
            "lane": F.col("k") % 5,
            "failed": F.col("channel") == "error",
        }
    )


def keyed(key: str, extra: str = "") -> str:
    return f"""rows AS MATERIALIZED (SELECT *, {key} AS key, epoch(ts) AS now{extra}, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM tx)"""


def ttl_sql(ttl: int, key: str = "concat(account_id, device_id)") -> str:
    return "WITH RECURSIVE " + ",\n".join(
        [
            TX,
            keyed(key),
            f"""f AS (SELECT event_id, key, rn, true AS accepted, now + {ttl} AS until FROM rows WHERE rn = 1
  UNION ALL SELECT r.event_id, r.key, r.rn, r.now >= f.until, CASE WHEN r.now >= f.until THEN r.now + {ttl} ELSE f.until END
  FROM f JOIN rows r ON r.key = f.key AND r.rn = f.rn + 1)""",
        ]
    ) + "\nSELECT event_id, accepted FROM f"


@query("x4_dedup_ttl_10min", ttl_sql(600))
def dedup_short(spark, sf):
    return controls.dedup_ttl(stamped(spark, sf), ["idem"], ORDER).select("event_id", "accepted")


@query("x4_dedup_ttl_1day", ttl_sql(86_400))
def dedup_day(spark, sf):
    return controls.dedup_ttl(stamped(spark, sf), ["idem"], ORDER, 86_400).select("event_id", "accepted")


@query("x4_dedup_ttl_1day_cut_keys", ttl_sql(86_400))
def dedup_cut(spark, sf):
    """The same with every key above ten rows cut into slices."""
    return controls.dedup_ttl(stamped(spark, sf), ["idem"], ORDER, 86_400, **cut_all(spark, sf, 10)).select("event_id", "accepted")


@query("x4_dedup_ttl_dense_keys", ttl_sql(86_400, "channel"))
def dedup_dense(spark, sf):
    """Very few keys, each with a row in every slice: states pass through dozens of slices."""
    return controls.dedup_ttl(stamped(spark, sf), ["channel"], ORDER, 86_400, **cut_all(spark, sf)).select("event_id", "accepted")


REPLAY_SQL = (
    "WITH RECURSIVE "
    + ",\n".join(
        [
            TX,
            keyed("concat(account_id, device_id)", ", (ts_long + (k % 4) * 50000)::DOUBLE AS exp").replace("FROM tx)", "FROM tx WHERE k % 17 <> 0)"),
            """g AS (SELECT *, exp - now <= 0 AS late FROM rows)""",
            """f AS (SELECT event_id, key, rn, CASE WHEN late THEN 'expired' ELSE 'ok' END AS reason, CASE WHEN late THEN 0 ELSE exp END AS until FROM g WHERE rn = 1
  UNION ALL SELECT r.event_id, r.key, r.rn, CASE WHEN late THEN 'expired' WHEN r.now < f.until THEN 'replay' ELSE 'ok' END,
    CASE WHEN late OR r.now < f.until THEN f.until ELSE r.exp END FROM f JOIN g r ON r.key = f.key AND r.rn = f.rn + 1)""",
        ]
    )
    + "\nSELECT event_id, reason FROM f UNION ALL SELECT event_id, 'missing_jti' FROM tx WHERE k % 17 = 0"
)


def tokens_of(spark, sf):
    return stamped(spark, sf).withColumns(
        {
            "jti": F.when(F.col("k") % 17 != 0, F.col("idem")),
            "exp": (F.col("ts_long") + (F.col("k") % 4) * 50_000).cast("double"),
        }
    )


@query("x5_replay_guard", REPLAY_SQL)
def replay_guard(spark, sf):
    return controls.replay_guard(tokens_of(spark, sf), "jti", ORDER).select("event_id", "reason")


@query("x5_replay_guard_cut_keys", REPLAY_SQL)
def replay_guard_cut(spark, sf):
    """The same with every token id above five rows cut into slices."""
    return controls.replay_guard(tokens_of(spark, sf), "jti", ORDER, **cut_all(spark, sf, 5)).select("event_id", "reason")


def bucket_sql(key: str = "account_id") -> str:
    return "WITH RECURSIVE " + ",\n".join(
        [
            TX,
            keyed(key),
            """f AS (SELECT event_id, key, rn, true AS allowed, 2::BIGINT AS tokens, now AS last FROM rows WHERE rn = 1
  UNION ALL SELECT event_id, key, rn, free >= 0, CASE WHEN free >= 0 THEN free ELSE tokens END, CASE WHEN free >= 0 THEN now ELSE last END FROM
  (SELECT r.event_id, r.key, r.rn, r.now, f.tokens, f.last, least(3, f.tokens + CAST(floor((r.now - f.last) / 60 * 0.002::DOUBLE) AS BIGINT)) - 1 AS free
   FROM f JOIN rows r ON r.key = f.key AND r.rn = f.rn + 1) s)""",
        ]
    ) + "\nSELECT event_id, allowed, CASE WHEN allowed THEN tokens ELSE 0 END AS tokens FROM f"


@query("x6_token_bucket", bucket_sql())
def token_bucket(spark, sf):
    return controls.token_bucket(stamped(spark, sf), ["account_id"], ORDER, 3, 0.002).select("event_id", "allowed", "tokens")


@query("x6_token_bucket_dense_keys", bucket_sql("channel"))
def token_bucket_dense(spark, sf):
    """Very few keys that are always short of tokens, cut into slices whose entry states never repeat."""
    out = controls.token_bucket(stamped(spark, sf), ["channel"], ORDER, 3, 0.002, **cut_all(spark, sf))
    return out.select("event_id", "allowed", "tokens")


@query("x6_token_bucket_cut_keys", bucket_sql())
def token_bucket_cut(spark, sf):
    """The same with every account above 30 rows cut into slices."""
    out = controls.token_bucket(stamped(spark, sf), ["account_id"], ORDER, 3, 0.002, **cut_all(spark, sf))
    return out.select("event_id", "allowed", "tokens")


BREAKER_SQL = (
    "WITH RECURSIVE "
    + ",\n".join(
        [
            TX,
            keyed("k % 5", ", channel = 'error' AS failed"),
            """f AS (SELECT event_id, key, rn, CASE WHEN failed THEN [now] ELSE CAST([] AS DOUBLE[]) END AS recent, 0.0::DOUBLE AS until, 'closed' AS state, false AS tripped
    FROM rows WHERE rn = 1
  UNION ALL SELECT event_id, key, rn, CASE WHEN refused THEN recent WHEN failed THEN kept ELSE CAST([] AS DOUBLE[]) END,
    CASE WHEN refused THEN until WHEN NOT failed THEN 0 WHEN len(kept) >= 5 THEN now + 18000 ELSE until END,
    CASE WHEN refused OR (failed AND len(kept) >= 5) THEN 'open' ELSE 'closed' END, NOT refused AND failed AND len(kept) >= 5
  FROM (SELECT r.event_id, r.key, r.rn, r.now, r.failed, f.recent, f.until, f.until > r.now AS refused,
      list_append(list_filter(f.recent, lambda t: t >= r.now - 36000), r.now) AS kept
    FROM f JOIN rows r ON r.key = f.key AND r.rn = f.rn + 1) s)""",
        ]
    )
    + "\nSELECT event_id, state, tripped FROM f"
)


@query("x7_breaker", BREAKER_SQL)
def breaker(spark, sf):
    out = controls.breaker(stamped(spark, sf), ["lane"], ORDER, window=36_000, open_for=18_000)
    return out.select("event_id", "state", "tripped")


EDGES = {"amount": [0.0, 15.0, 35.0, 70.0, 150.0], "k": [0.0, 25.0, 50.0, 75.0, 100.0]}
EXPECTED = {name: [0.25] * 4 for name in EDGES}


def drift_rows(spark, sf, monitors=16):
    """Both features of every transaction, each reported to one of the monitors."""
    t = stamped(spark, sf)
    cells = [F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in EDGES]
    long = t.select("event_id", "ts", "ts_long", (F.col("user_id") % monitors).alias("monitor"), F.explode(F.array(*cells)).alias("c"))
    return long.select("event_id", "ts", "ts_long", "monitor", "c.*")


def psi_sql(monitors: int = 16) -> str:
    terms = " + ".join(
        f"(greatest(c{i} / greatest(c0 + c1 + c2 + c3, 1), 1e-6::DOUBLE) - 0.25::DOUBLE) * ln(greatest(c{i} / greatest(c0 + c1 + c2 + c3, 1), 1e-6::DOUBLE) / 0.25::DOUBLE)"
        for i in range(4)
    )
    counted = ", ".join(f"f.c{i} + CASE WHEN bin = {i} THEN 1 ELSE 0 END AS c{i}" for i in range(4))
    decayed = ", ".join(f"CASE WHEN m >= 200 THEN floor(c{i} * 0.9::DOUBLE) ELSE c{i} END" for i in range(4))
    bounds = "CASE WHEN feature = 'amount' THEN CASE WHEN v < 15 THEN 0 WHEN v < 35 THEN 1 WHEN v < 70 THEN 2 ELSE 3 END ELSE least(floor(v / 25), 3) END"
    return "WITH RECURSIVE " + ",\n".join(
        [
            TX,
            f"""rows AS MATERIALIZED (SELECT *, CAST({bounds} AS INTEGER) AS bin, row_number() OVER (PARTITION BY feature, monitor ORDER BY ts, event_id) AS rn FROM
  (SELECT event_id, ts, user_id % {monitors} AS monitor, 'amount' AS feature, amount AS v FROM tx
   UNION ALL SELECT event_id, ts, user_id % {monitors}, 'k', k::DOUBLE FROM tx) u)""",
            f"""f AS (SELECT CAST(NULL AS BIGINT) AS event_id, feature, monitor, 0::BIGINT AS rn, 0::DOUBLE AS n, 0::DOUBLE AS c0, 0::DOUBLE AS c1, 0::DOUBLE AS c2, 0::DOUBLE AS c3,
    0::DOUBLE AS psi FROM rows WHERE rn = 1
  UNION ALL SELECT event_id, feature, monitor, rn, CASE WHEN m >= 200 THEN floor(m * 0.9::DOUBLE) ELSE m END, {decayed}, {terms} FROM
  (SELECT r.event_id, r.feature, r.monitor, r.rn, least(f.n + 1, 200) AS m, {counted}
   FROM f JOIN rows r ON r.feature = f.feature AND r.monitor = f.monitor AND r.rn = f.rn + 1) s)""",
        ]
    ) + "\nSELECT event_id, feature, round(psi, 6) AS psi, psi >= 0.3::DOUBLE AS alert FROM f WHERE rn > 0"


@query("x8_running_drift", psi_sql())
def running_drift(spark, sf):
    out = controls.running_drift(drift_rows(spark, sf), EDGES, EXPECTED, ["feature", "monitor"], ORDER, window=200)
    return out.select("event_id", "feature", F.round("psi", 6).alias("psi"), "alert")


@query("x8_running_drift_one_monitor", psi_sql(1))
def running_drift_one(spark, sf):
    """All rows of a feature under one key, cut into slices."""
    out = controls.running_drift(drift_rows(spark, sf, 1), EDGES, EXPECTED, ["feature", "monitor"], ORDER, window=200, **cut_all(spark, sf))
    return out.select("event_id", "feature", F.round("psi", 6).alias("psi"), "alert")


@query(
    "x10_hash_chain",
    """WITH RECURSIVE rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (SELECT conv_id, turn, rn, sha256(text) AS chain FROM rows WHERE rn = 1
  UNION ALL SELECT r.conv_id, r.turn, r.rn, sha256(unhex(f.chain) || encode(r.text)) FROM f JOIN rows r ON r.conv_id = f.conv_id AND r.rn = f.rn + 1)
SELECT conv_id, turn, chain FROM f""",
)
def hash_chain(spark, sf):
    return controls.hash_chain(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "chain")


# Models.
NUMERIC = ["amount", "k", "location_risk_score", "ip_risk_score", "vpn_detected"]


@query("t1_fit_logistic")
def fit_logistic(spark, sf):
    s = scored(spark, sf)
    return ml.fit_logistic(s, NUMERIC, "channel", "y").transform(s).select("event_id", "y", "probability")


@query("t2_fit_forest")
def fit_forest(spark, sf):
    s = scored(spark, sf)
    return ml.fit_forest(s, NUMERIC, "y").transform(s).select("event_id", "y", "probability")


@query("t3_isolation_forest")
def isolation_forest(spark, sf):
    """Share of rows flagged as outliers, which the offset sets to the contamination."""
    s = scored(spark, sf)
    forest = ml.fit_iforest(s.where("y = 0"), NUMERIC, "event_id")
    out = forest.score(s.where("y = 0"))
    flagged = F.sum((F.col("anomaly_raw") < 0).cast("bigint"))
    return out.agg(F.count(F.lit(1)).alias("rows"), flagged.alias("flagged"))


@query("t4_reconstruct", "SELECT vec_id, 64 AS width, true AS closer_than_origin FROM embeddings")
def reconstruct(spark, sf):
    from riskweave.functions.numbers import norm, squared_error

    e = table(spark, sf, "embeddings")
    out = ml.reconstruct(e, ml.fit_recon(e, "embedding", 16), "embedding")
    error = F.sqrt(squared_error(F.col("embedding"), F.col("recon")))
    return out.select("vec_id", F.size("recon").alias("width"), (error <= norm(F.col("embedding")) + 1e-6).alias("closer_than_origin"))


@query("t4_autoencoder")
def autoencoder(spark, sf):
    """The network of the reference's shape, trained on all vectors; how far each reconstruction is off."""
    from riskweave.functions.numbers import squared_error

    e = table(spark, sf, "embeddings")
    out = ml.fit_autoencoder(e, "embedding").reconstruct(e, "embedding")
    return out.select("vec_id", F.size("recon").alias("width"), F.round(squared_error(F.col("embedding"), F.col("recon")), 4).alias("error"))


@query(
    "t5_score_dense",
    """SELECT vec_id, round(least(1.0::DOUBLE, 10 * list_sum(list_transform(embedding, lambda x: CASE WHEN x < 0 THEN x::DOUBLE * x::DOUBLE ELSE 0.0::DOUBLE END)) / 64), 4)
  AS autoencoder FROM embeddings""",
)
def score_dense(spark, sf):
    """Identity layers with a rectifier in between: the network loses exactly the negative part."""
    eye, zero = np.eye(64, dtype=np.float32), np.zeros(64, dtype=np.float32)
    weights = {"mean": np.float32(0), "std": np.float32(1), "layers": [(eye, zero, True), (eye, zero, False)]}
    out = ml.score_dense(table(spark, sf, "embeddings"), weights, "embedding")
    return out.select("vec_id", F.round("autoencoder", 4).alias("autoencoder"))


@query(
    "t5_score_lstm",
    with_sql(
        TX,
        """c AS (SELECT event_id, k % 6 AS n, coalesce(list_sum(list_transform(range(k % 6), lambda t: power(0.5::DOUBLE, k % 6 - t) * tanh(amount / 100 + t))), 0) AS c FROM tx)""",
        body="SELECT event_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(1 / (1 + exp(-(3 * (0.5::DOUBLE * tanh(c)) - 1))), 6) END AS lstm FROM c",
    ),
)
def score_lstm(spark, sf):
    """Sequences of up to five steps; the gates stand half open, so the last step has a closed form."""
    w_ih = np.zeros((4, 2))
    w_ih[2, 0] = 1.0
    weights = {
        "mean": np.zeros(2), "std": np.ones(2), "w_ih": w_ih, "w_hh": np.zeros((4, 1)), "b": np.zeros(4),
        "head": [(np.ones((1, 1)), np.zeros(1)), (np.full((1, 1), 3.0), np.full(1, -1.0))],
    }
    step = lambda i: F.array(F.col("amount") / 100 + i, (F.col("k") / 100).cast("double"))
    steps = F.slice(F.array(*[step(float(i)) for i in range(5)]), 1, F.col("k") % 6)
    out = ml.score_lstm(tx(spark, sf).withColumn("sequence", steps), weights, "sequence")
    return out.select("event_id", F.round("lstm", 6).alias("lstm"))


def reloaded(model):
    """The model after a round trip through the shared folder."""
    from pyspark.sql import SparkSession

    from riskweave.session import shared_dir

    path = f"{shared_dir(SparkSession.active())}/riskweave-models/{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).read().load(path)


@query("t1_reloaded_logistic", with_sql(TX, body="SELECT event_id, CAST(amount + k > 120 AS INT) AS y, true AS same FROM tx"))
def reloaded_logistic(spark, sf):
    """A saved and reloaded model gives every row the same probability."""
    s = scored(spark, sf)
    model = ml.LogisticTrainer(NUMERIC, "channel", "y").fit(s)
    both = reloaded(model).transform(model.transform(s).withColumnRenamed("probability", "first"))
    return both.select("event_id", "y", F.col("first").eqNullSafe(F.col("probability")).alias("same"))


@query("t3_reloaded_isolation_forest", with_sql(TX, body="SELECT event_id, true AS same FROM tx"))
def reloaded_forest(spark, sf):
    s = scored(spark, sf)
    forest = ml.fit_iforest(s.where("y = 0"), NUMERIC, "event_id")
    both = reloaded(forest).score(forest.score(s, "first"))
    return both.select("event_id", F.col("first").eqNullSafe(F.col("anomaly_raw")).alias("same"))


@query("t6_train_report")
def train_report(spark, sf):
    s = scored(spark, sf)
    return ml.train_report(s, NUMERIC, "y")


@query("m12_score_local")
def score_local(spark, sf):
    s = scored(spark, sf)
    out = ml.score_local(s, ml.fit_forest(s, NUMERIC, "y"))
    return out.select("event_id", "probability", "decision")
