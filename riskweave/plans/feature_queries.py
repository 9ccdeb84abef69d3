"""Window, scalar and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import numbers, privacy, times
from riskweave.operators import asof, features, jobs, validate
from riskweave.plans.registry import query
from riskweave.plans.views import TX, cut_all, tx, with_sql
from riskweave.schema import MODEL_FEATURES, VECTOR_FIELDS
from riskweave.sources.tables import table

ROWS = "PARTITION BY account_id ORDER BY ts, transaction_id"
FRAME = f"({ROWS} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"


def span(seconds: int) -> str:
    return f"(PARTITION BY account_id ORDER BY ts_long RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)"


Z = (
    f"CASE WHEN stddev_pop(amount) OVER {FRAME} > 0 THEN (amount - avg(amount) OVER {FRAME}) / stddev_pop(amount) OVER {FRAME} "
    "ELSE 0.0::DOUBLE END"
)
CHANGED = f"CASE WHEN lag(device_id) OVER ({ROWS}) <> device_id THEN 1 ELSE 0 END"
MOVED = f"moved AS (SELECT *, CASE WHEN lag(ip) OVER ({ROWS}) <> ip THEN 1 ELSE 0 END AS m FROM tx)"


def window_query(name: str, fn, column: str, expression: str, digits: int | None = None, extra: str = "", source: str = "tx"):
    """Register one window feature: id and column, rounded where it is a double."""
    value = f"round({expression}, {digits})" if digits is not None else expression
    parts = (TX, extra) if extra else (TX,)

    @query(name, with_sql(*parts, body=f"SELECT transaction_id, {value} AS {column} FROM {source}"))
    def run(spark, sf):
        out = F.col(column) if digits is None else F.round(column, digits)
        return fn(tx(spark, sf)).select("transaction_id", out.alias(column))


window_query("w1_rolling_mean", features.rolling_mean, "rolling_mean", f"avg(amount) OVER {FRAME}", 6)
window_query("w2_rolling_std", features.rolling_std, "rolling_std", f"stddev_pop(amount) OVER {FRAME}", 6)
window_query("w3_amount_z", features.amount_z, "amount_z", Z, 6)
window_query("w4_new_device", features.new_device, "new_device", CHANGED)
window_query("w5_rolling_amount_5m", features.rolling_amount_5m, "rolling_amount_5m", f"sum(amount) OVER {span(300)}", 6)
window_query(
    "w5_rolling_amount_24h", lambda d: features.rolling_amount_5m(d, seconds=86_400), "rolling_amount_5m", f"sum(amount) OVER {span(86400)}", 6
)
window_query("w6_amount_ratio", features.amount_ratio, "amount_ratio", f"amount / (sum(amount) OVER {span(300)} + 0.001::DOUBLE)", 6)
window_query(
    "w7_transaction_frequency_30min", features.transaction_frequency_30min, "transaction_frequency_30min", f"count(*) OVER {span(1800)}"
)
window_query("w8_transactions_last_24h", features.transactions_last_24h, "transactions_last_24h", f"count(*) OVER {span(86400)}")
window_query(
    "w9_avg_transaction_amount_24h", features.avg_transaction_amount_24h, "avg_transaction_amount_24h", f"avg(amount) OVER {span(86400)}", 6
)
window_query(
    "w10_unique_receivers_24h", features.unique_receivers_24h, "unique_receivers_24h", f"count(DISTINCT receiver_id) OVER {span(86400)}"
)
window_query(
    "w11_time_since_last_tx", features.time_since_last_tx, "time_since_last_tx", f"coalesce(ts_long - lag(ts_long) OVER ({ROWS}), 0)"
)
window_query(
    "w12_login_ip_changed_last_hour", features.login_ip_changed_last_hour, "login_ip_changed_last_hour", f"max(m) OVER {span(3600)}",
    extra=MOVED, source="moved",
)
window_query(
    "w12_login_ip_changed_last_day", lambda d: features.login_ip_changed_last_hour(d, seconds=86_400), "login_ip_changed_last_hour",
    f"max(m) OVER {span(86400)}", extra=MOVED, source="moved",
)

VECTOR_SQL = with_sql(
    TX,
    body=f"""SELECT transaction_id, round(avg(amount) OVER {FRAME}, 6) AS rolling_mean, round(stddev_pop(amount) OVER {FRAME}, 6) AS rolling_std,
  round({Z}, 6) AS amount_z, {CHANGED} AS new_device, round(sum(amount) OVER {span(300)}, 6) AS rolling_amount_5m,
  round(amount / (sum(amount) OVER {span(300)} + 0.001::DOUBLE), 6) AS amount_ratio,
  CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 1 ELSE 0 END AS is_night FROM tx""",
)


def vector_columns(df):
    rounded = ["rolling_mean", "rolling_std", "amount_z", "rolling_amount_5m", "amount_ratio"]
    return df.select("transaction_id", "new_device", "is_night", *[F.round(c, 6).alias(c) for c in rounded])


@query("w1_to_w6_vector_features", VECTOR_SQL)
def vector_features(spark, sf):
    return vector_columns(features.stream_vector_features(tx(spark, sf)))


@query("w1_to_w6_vector_features_cut_accounts", VECTOR_SQL)
def vector_features_cut(spark, sf):
    """The same columns with every account above 30 rows cut into slices and panes."""
    return vector_columns(features.stream_vector_features(tx(spark, sf), **cut_all(spark, sf)))


@query(
    "w7_to_w12_model_features_cut_accounts",
    with_sql(
        TX, MOVED,
        body=f"""SELECT transaction_id, count(*) OVER {span(1800)} AS transaction_frequency_30min,
  count(*) OVER {span(86400)} AS transactions_last_24h, round(avg(amount) OVER {span(86400)}, 6) AS avg_transaction_amount_24h,
  max(m) OVER {span(3600)} AS login_ip_changed_last_hour, coalesce(ts_long - lag(ts_long) OVER ({ROWS}), 0) AS time_since_last_tx,
  count(DISTINCT receiver_id) OVER {span(86400)} AS unique_receivers_24h FROM moved""",
    ),
)
def model_features_cut(spark, sf):
    made = features.model_features(tx(spark, sf), receivers=True, **cut_all(spark, sf))
    return made.select(
        "transaction_id", "transaction_frequency_30min", "transactions_last_24h", "login_ip_changed_last_hour", "time_since_last_tx",
        "unique_receivers_24h", F.round("avg_transaction_amount_24h", 6).alias("avg_transaction_amount_24h"),
    )


# Sliding windows and the joins with them.
STATS = """ends AS (
  SELECT account_id, amount, unnest(generate_series(CAST(floor(ts_long / 10.0) AS BIGINT) * 10 + 10,
         CAST(floor(ts_long / 10.0) AS BIGINT) * 10 + 60, 10)) AS window_end FROM tx),
stats AS (
  SELECT account_id, window_end, avg(amount) AS avg_amount, stddev_pop(amount) AS std_amount, max(amount) AS max_amount
  FROM ends GROUP BY account_id, window_end)"""


def rounded_stats(df, *keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in ("avg_amount", "std_amount", "max_amount")])


STAT_COLUMNS = "round(avg_amount, 6) AS avg_amount, round(std_amount, 6) AS std_amount, round(max_amount, 6) AS max_amount"


@query("a1_window_stats", with_sql(TX, STATS, body=f"SELECT account_id, window_end, {STAT_COLUMNS} FROM stats"))
def window_stats(spark, sf):
    return rounded_stats(features.window_stats(tx(spark, sf)), "account_id", "window_end")


@query(
    "j1_join_stats",
    with_sql(
        TX, STATS,
        body=f"""SELECT transaction_id, s.window_end, {STAT_COLUMNS} FROM tx LEFT JOIN stats s
  ON tx.account_id = s.account_id AND s.window_end > tx.ts_long AND s.window_end <= tx.ts_long + 60""",
    ),
)
def join_stats(spark, sf):
    t = tx(spark, sf)
    return rounded_stats(asof.join_stats(t, features.window_stats(t)), "transaction_id", "window_end")


JOB_SQL = with_sql(
    TX, STATS,
    f"""made AS (SELECT transaction_id, account_id, ts_long, amount, round(amount / (sum(amount) OVER {span(300)} + 0.001::DOUBLE), 6) AS amount_ratio, {CHANGED} AS new_device,
  round({Z}, 6) AS amount_z, CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 1 ELSE 0 END AS is_night, k / 100.0::DOUBLE AS velocity, CASE WHEN k % 9 <> 0 THEN k / 200.0::DOUBLE END AS behavior_score FROM tx)""",
    body=f"""SELECT transaction_id, s.window_end, amount, velocity, is_night, amount_ratio, new_device, behavior_score, amount_z, {STAT_COLUMNS}
  FROM made LEFT JOIN stats s ON made.account_id = s.account_id AND s.window_end > made.ts_long AND s.window_end <= made.ts_long + 60""",
)


def feature_job(spark, sf, **cut):
    body = F.struct(
        "transaction_id", "account_id", "amount", F.col("ts").alias("timestamp"), "channel", "device_id", (F.col("k") / 100.0).alias("velocity"),
        F.when(F.col("k") % 9 != 0, F.col("k") / 200.0).alias("behavior_score"),
    )
    out = jobs.feature_vectors(tx(spark, sf).select(F.to_json(body).cast("binary").alias("value")), **cut)
    kinds = {"is_night": "int", "new_device": "int"}
    fields = F.from_json("feature_vector", ", ".join(f"{n} {kinds.get(n, 'double')}" for n in VECTOR_FIELDS))
    read = out.withColumn("v", fields).select("transaction_id", "window_end", "v.*", "avg_amount", "std_amount", "max_amount")
    rounded = ("amount_ratio", "amount_z", "avg_amount", "std_amount", "max_amount")
    return read.withColumns({c: F.round(c, 6) for c in rounded})


@query("x12_feature_job", JOB_SQL)
def whole_feature_job(spark, sf):
    """Messages in, published vectors with their windows out."""
    return feature_job(spark, sf)


@query("x12_feature_job_cut_accounts", JOB_SQL)
def whole_feature_job_cut(spark, sf):
    return feature_job(spark, sf, **cut_all(spark, sf))


ASOF_SQL = with_sql(
    TX, STATS,
    body=f"""SELECT transaction_id, s.window_end, {STAT_COLUMNS}
  FROM tx ASOF LEFT JOIN stats s ON tx.account_id = s.account_id AND tx.ts_long >= s.window_end""",
)


@query("j2_asof_stats", ASOF_SQL)
def asof_stats(spark, sf):
    t = tx(spark, sf)
    return rounded_stats(asof.asof_stats(t, features.window_stats(t)), "transaction_id", "window_end")


@query("j2_asof_stats_cut_accounts", ASOF_SQL)
def asof_stats_cut(spark, sf):
    """The same with every account above 30 rows cut into slices that hand their last value on."""
    t = tx(spark, sf)
    return rounded_stats(asof.asof_stats(t, features.window_stats(t), **cut_all(spark, sf)), "transaction_id", "window_end")


# Scalars.
def scalar_query(name: str, columns, sql: str, parts=(TX,), source="tx", view=tx, keep=("transaction_id",)):
    @query(name, with_sql(*parts, body=f"SELECT {', '.join(keep)}, {sql} FROM {source}"))
    def run(spark, sf):
        return view(spark, sf).select(*keep, *[c.alias(n) for n, c in columns(F.col("ts")).items()])


scalar_query("f1_hour_of_day", lambda ts: {"hour_of_day": times.hour_of_day(ts)}, "CAST(hour(ts) AS INTEGER) AS hour_of_day")
scalar_query(
    "f2_night_activity", lambda ts: {"night_activity": times.night_activity(ts)}, "CASE WHEN hour(ts) < 6 OR hour(ts) = 23 THEN 1 ELSE 0 END AS night_activity"
)
scalar_query(
    "f3_time_columns",
    lambda ts: {
        "is_weekend": times.is_weekend(ts),
        "time_seconds": times.time_seconds(ts),
        "hour_sin": F.round(times.cyclic_hour(ts)[0], 6),
        "hour_cos": F.round(times.cyclic_hour(ts)[1], 6),
    },
    "CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, ts_long AS time_seconds, "
    "round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos",
)
scalar_query(
    "f4_is_round_amount", lambda ts: {"is_round_amount": numbers.is_round_amount(F.col("amount"))}, "CAST(amount = floor(amount) AS INTEGER) AS is_round_amount"
)
scalar_query("f5_epoch_seconds", lambda ts: {"epoch": times.epoch_seconds(ts)}, "CAST(floor(epoch(ts)) AS BIGINT) AS epoch")
scalar_query("f7_iso_ts", lambda ts: {"iso": times.iso_ts(ts)}, "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso")
scalar_query(
    "f8_ip_cidr24",
    lambda ts: {"cidr": privacy.ip_cidr24(F.col("ip")), "other": privacy.ip_cidr24(F.col("device_id"))},
    "concat(regexp_extract(ip, '^([0-9]+\\.[0-9]+\\.[0-9]+)\\.', 1), '.0/24') AS cidr, device_id AS other",
)
scalar_query(
    "f9_valid_device",
    lambda ts: {"good": privacy.valid_device(F.col("device_id")), "bad": privacy.valid_device(F.col("account_id"))},
    "regexp_full_match(device_id, '[A-Za-z0-9]+') AS good, regexp_full_match(account_id, '[A-Za-z0-9]+') AS bad",
)
scalar_query(
    "f16_clip01",
    lambda ts: {"clipped": F.round(numbers.clip01(F.col("amount") / 100 - 0.2), 6)},
    "round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, amount / 100 - 0.2::DOUBLE)), 6) AS clipped",
)


@query(
    "f6_feature_json",
    with_sql(
        TX,
        body="""SELECT transaction_id, concat('{"channel":"', channel, '"', CASE WHEN k % 4 <> 0 THEN concat(',"k":', CAST(k AS VARCHAR)) ELSE '' END,
  ',"device_id":"', device_id, '"}') AS feature_vector FROM tx""",
    ),
)
def feature_json(spark, sf):
    t = tx(spark, sf).withColumn("k", F.when(F.col("k") % 4 != 0, F.col("k")))
    return features.feature_json(t, ["channel", "k", "device_id"]).select("transaction_id", "feature_vector")


PAN, IBAN, IP = (pattern for pattern, _ in privacy.PII_PATTERNS)


def mask_sql(value: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({value}, '{PAN}', '<PAN>', 'g'), '{IBAN}', '<IBAN>', 'g'), '{IP}', '<IP>', 'g')"


@query("f10_mask_pii", f"SELECT doc_id, {mask_sql('text')} AS masked FROM documents")
def mask_pii(spark, sf):
    return table(spark, sf, "documents").select("doc_id", privacy.mask_pii(F.col("text")).alias("masked"))


@query("f20_mask_agent", f"SELECT doc_id, {mask_sql('substring(text, 1, 120)')} AS agent FROM documents")
def mask_agent(spark, sf):
    return table(spark, sf, "documents").select("doc_id", privacy.mask_agent(F.col("text")).alias("agent"))


@query("f13_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", privacy.content_hash(F.col("text")).alias("hash"))


@query("f14_sanitize_name", "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS name FROM part")
def sanitize_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", privacy.sanitize_name(F.col("p_name")).alias("name"))


# Validation.
def feature_rows(spark, sf):
    """Feature rows with planted violations: negative amounts, hours above 23, risk above 1, odd segments."""
    k = F.col("k")
    return tx(spark, sf).select(
        "transaction_id",
        (F.col("amount") - 3).alias("transaction_amount"),
        F.col("ts_long").alias("transaction_time_seconds"),
        times.is_weekend(F.col("ts")).alias("is_weekend"),
        (k % 26).alias("hour_of_day"),
        F.lit(0).alias("is_round_amount"),
        (k % 20).alias("unique_receivers_24h"),
        F.col("vpn_detected"),
        (F.col("location_risk_score") * 1.1).alias("location_risk_score"),
        F.when(k % 30 != 0, k).alias("transaction_frequency_30min"),
        F.lit(0).alias("login_ip_changed_last_hour"),
        F.col("amount").alias("avg_transaction_amount_24h"),
        F.lit(0).alias("time_since_last_tx"),
        F.col("ip_risk_score"),
        (k + 1).alias("transactions_last_24h"),
        F.when(k % 7 == 0, "vip").when(k % 7 == 1, "premium").otherwise("standard").alias("customer_segment"),
    )


@query(
    "p1_validate",
    with_sql(
        TX,
        body="""SELECT transaction_id, concat_ws(',', CASE WHEN amount - 3 < 0 THEN 'transaction_amount' END,
    CASE WHEN k % 26 > 23 THEN 'hour_of_day' END, CASE WHEN location_risk_score * 1.1::DOUBLE > 1 THEN 'location_risk_score' END,
    CASE WHEN k % 30 = 0 THEN 'transaction_frequency_30min' END, CASE WHEN k % 7 = 0 THEN 'customer_segment' END) AS violations,
  amount - 3 >= 0 AND k % 26 <= 23 AND location_risk_score * 1.1::DOUBLE <= 1 AND k % 30 <> 0 AND k % 7 <> 0 AS valid FROM tx""",
    ),
)
def p1_validate(spark, sf):
    checked = validate.validate(feature_rows(spark, sf), validate.feature_rules())
    return checked.select(
        "transaction_id", F.array_join("violations", ",").alias("violations"), (F.size("violations") == 0).alias("valid")
    )


@query(
    "p2_reject_extra",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'extra' ELSE '' END AS extra_fields FROM events",
)
def p2_reject_extra(spark, sf):
    e = table(spark, sf, "events")
    body = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r"\}$", ', "extra": 1}')).otherwise(F.col("props"))
    out = validate.reject_extra(e.withColumn("body", body), "body", ["k"])
    return out.select("event_id", F.array_join("extra_fields", ",").alias("extra_fields"))


@query(
    "p3_apply_defaults",
    with_sql(
        TX,
        body="""SELECT transaction_id, CASE WHEN k % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN k % 3 = 0 THEN 'unknown' ELSE channel END AS channel, ts_long FROM tx""",
    ),
)
def p3_apply_defaults(spark, sf):
    t = tx(spark, sf).withColumns(
        {"currency": F.when(F.col("k") % 2 == 1, "USD"), "channel": F.when(F.col("k") % 3 != 0, F.col("channel"))}
    )
    return validate.apply_defaults(t).select("transaction_id", "currency", "channel", times.epoch_seconds(F.col("ts")).alias("ts_long"))


@query(
    "p4_vectorize",
    with_sql(TX, body="SELECT transaction_id, concat_ws(',', amount, 0.0::DOUBLE, CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE ELSE k::DOUBLE END) AS vector FROM tx"),
)
def p4_vectorize(spark, sf):
    t = tx(spark, sf).withColumn("k", F.when(F.col("k") % 4 != 0, F.col("k")))
    out = validate.vectorize(t, ["amount", "velocity", "k"])
    return out.select("transaction_id", F.array_join(F.transform("vector", lambda v: v.cast("string")), ",").alias("vector"))


@query(
    "p5_model_frame",
    with_sql(
        TX,
        body="SELECT transaction_id, "
        + ", ".join(
            f"{ {'location_risk_score': 'location_risk_score', 'ip_risk_score': 'ip_risk_score', 'vpn_detected': 'CAST(vpn_detected AS DOUBLE)'}.get(n, 'CAST(NULL AS DOUBLE)') } AS {n}"
            for n in MODEL_FEATURES
        )
        + " FROM tx",
    ),
)
def p5_model_frame(spark, sf):
    return validate.model_frame(tx(spark, sf), MODEL_FEATURES, ["transaction_id"])
