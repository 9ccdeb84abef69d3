"""Transaction-shaped views of the given tables, once as DataFrames and once as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.times import epoch_seconds
from riskweave.sources.tables import table


def tx(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return shape_tx(e)


def shape_tx(e: DataFrame) -> DataFrame:
    e = e.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    text = lambda c: F.col(c).cast("string")
    return e.select(
        text("event_id").alias("transaction_id"),
        F.concat(F.lit("acc_"), text("user_id")).alias("account_id"),
        F.col("value").alias("amount"),
        F.lit("EUR").alias("currency"),
        "ts",
        epoch_seconds(F.col("ts")).alias("ts_long"),
        F.col("event_type").alias("channel"),
        "k",
        F.concat(F.lit("dev"), (F.col("k") % 3).cast("string")).alias("device_id"),
        F.concat(F.lit("r"), text("k")).alias("receiver_id"),
        F.concat(
            F.lit("10."), (F.col("k") % 2).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"), F.lit("."), text("k")
        ).alias("ip"),
        (F.col("k") % 10 == 0).cast("int").alias("vpn_detected"),
        ((F.col("k") % 100) / 100.0).alias("location_risk_score"),
        ((F.col("user_id") % 100) / 100.0).alias("ip_risk_score"),
        "user_id",
        "event_id",
    )


TX = """tx AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, concat('acc_', CAST(user_id AS VARCHAR)) AS account_id,
         value AS amount, 'EUR' AS currency, ts, CAST(floor(epoch(ts)) AS BIGINT) AS ts_long, event_type AS channel, k,
         concat('dev', CAST(k % 3 AS VARCHAR)) AS device_id, concat('r', CAST(k AS VARCHAR)) AS receiver_id,
         concat('10.', CAST(k % 2 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR), '.', CAST(k AS VARCHAR)) AS ip,
         CAST(k % 10 = 0 AS INTEGER) AS vpn_detected,
         CAST(k % 100 AS DOUBLE) / 100 AS location_risk_score, CAST(user_id % 100 AS DOUBLE) / 100 AS ip_risk_score,
         user_id, event_id
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) z)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return tx(spark, sf).select(
        "*",
        F.least(F.lit(1.0), F.col("amount") / 150.0).alias("p"),
        (F.col("amount") + F.col("k") > 120).cast("int").alias("y"),
    )


SCORED = "scored AS (SELECT *, least(1.0::DOUBLE, amount / 150) AS p, CAST(amount + k > 120 AS INTEGER) AS y FROM tx)"


def components(spark: SparkSession, sf: str) -> DataFrame:
    return tx(spark, sf).select(
        "*",
        F.least(F.lit(1.0), F.col("amount") / 200.0).alias("tabular"),
        F.col("location_risk_score").alias("graph"),
        F.when(F.col("k") % 4 != 0, F.col("ip_risk_score")).alias("autoencoder"),
        F.lit(0.0).alias("lstm"),
    )


COMPONENTS = """components AS (
  SELECT *, least(1.0::DOUBLE, amount / 200) AS tabular, location_risk_score AS graph,
         CASE WHEN k % 4 = 0 THEN NULL ELSE ip_risk_score END AS autoencoder, 0.0::DOUBLE AS lstm FROM tx)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.col("channel") == "error"
    return tx(spark, sf).select(
        "event_id",
        "ts",
        "ts_long",
        F.lit("POST").alias("method"),
        F.concat(F.lit("/"), F.col("channel")).alias("path"),
        F.when(failed, F.col("k") % 4 + 500).otherwise(200).alias("status"),
        F.col("amount").alias("latency_ms"),
        (F.col("event_id") % 500).alias("correlation_id"),
        F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("service"),
        "k",
        "user_id",
        "channel",
    )


REQUESTS = """requests AS (
  SELECT event_id, ts, ts_long, 'POST' AS method, concat('/', channel) AS path,
         CASE WHEN channel = 'error' THEN 500 + k % 4 ELSE 200 END AS status, amount AS latency_ms,
         event_id % 500 AS correlation_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS service, k, user_id, channel
  FROM tx)"""


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counter samples per event type that restart every 500 ids."""
    return tx(spark, sf).select(
        F.col("channel").alias("name"), "ts_long", F.col("event_id").alias("seq"), (F.col("event_id") % 500).alias("value"), "user_id"
    )


COUNTERS = "counters AS (SELECT channel AS name, ts_long, event_id AS seq, event_id % 500 AS value, user_id FROM tx)"


def drift_base(spark: SparkSession) -> DataFrame:
    """Baseline of two features: four bins of a quarter each."""
    edges = {"amount": [0.0, 15.0, 35.0, 70.0, 150.0], "k": [0.0, 25.0, 50.0, 75.0, 100.0]}
    rows = [(f, i, e[i], e[i + 1], 0.25) for f, e in edges.items() for i in range(4)]
    return spark.createDataFrame(rows, "feature string, bin int, lo double, hi double, expected double")


DRIFT_BASE = """drift_base AS (
  SELECT feature, CAST(i AS INTEGER) AS bin, CAST(edges[i + 1] AS DOUBLE) AS lo, CAST(edges[i + 2] AS DOUBLE) AS hi, 0.25::DOUBLE AS expected
  FROM (VALUES ('amount', [0, 15, 35, 70, 150]), ('k', [0, 25, 50, 75, 100])) b(feature, edges), range(4) r(i))"""


def cut_all(spark: SparkSession, sf: str, limit: int = 30) -> dict[str, int]:
    """Options that send every key above ``limit`` rows through the hot-key form, in about 32 slices whatever the scale."""
    return {"limit": limit, "rows": max(100, table(spark, sf, "events").count() // 32)}


def with_sql(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body
