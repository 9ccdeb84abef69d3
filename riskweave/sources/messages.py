"""Decoding, stamping and enveloping of transaction messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.times import iso_ts
from riskweave.schema import TRANSACTION


def parse_txn(df: DataFrame, col: str = "value") -> DataFrame:
    """JSON payload as the fixed record; malformed payloads give nulls."""
    return df.select(F.from_json(F.col(col).cast("string"), TRANSACTION).alias("p")).select("p.*")


def envelope(df: DataFrame, keep_id: str = "message_id") -> DataFrame:
    """Publishable rows ``key, value, bytes``: the given message id or a new one, the row as JSON, its size."""
    given = F.col(keep_id) if keep_id in df.columns else F.lit(None).cast("string")
    with_id = df.withColumn("message_id", F.coalesce(given, F.uuid()))
    body = ["message_id", *[c for c in df.columns if c != "message_id"]]
    out = with_id.select(F.col("message_id").alias("key"), F.to_json(F.struct(*body)).alias("value"))
    return out.withColumn("bytes", F.octet_length("value"))


def stamp_ingest(df: DataFrame, ts: str = "ts", now: Column | None = None) -> DataFrame:
    """ISO event time and time of receipt."""
    received = F.current_timestamp() if now is None else now
    return df.withColumns({"timestamp": iso_ts(F.col(ts)), "received_at": iso_ts(received)})
