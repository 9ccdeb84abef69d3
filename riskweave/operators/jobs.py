"""The feature job from message to published vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.times import epoch_seconds
from riskweave.operators import asof, features
from riskweave.schema import VECTOR_FIELDS
from riskweave.session import cut as write_table
from riskweave.sources.messages import parse_txn


def feature_vectors(messages: DataFrame, col: str = "value", **cut) -> DataFrame:
    """Published vectors of JSON transactions: parse, describe each row by its account's history, join the account's windows.

    Rows: transaction_id, account_id, event_time, the vector of ``VECTOR_FIELDS`` as JSON (``feature_vector``, null fields left
    out), and window_end, avg_amount, std_amount, max_amount, one row for each window that holds the transaction.  Messages
    that don't parse have null fields and meet no window.  ``cut``: how accounts of very many rows are spread.
    """
    parsed = parse_txn(messages, col).withColumnRenamed("timestamp", "ts").withColumn("ts_long", epoch_seconds(F.col("ts")))
    parsed = write_table(parsed)  # counted, sliced, windowed and described: messages are parsed once
    described = features.stream_vector_features(parsed, **cut)
    joined = asof.join_stats(described, features.window_stats(parsed.where("ts is not null")))
    vector = features.feature_json(joined, VECTOR_FIELDS)
    return vector.select("transaction_id", "account_id", F.col("ts").alias("event_time"), "feature_vector", "window_end", "avg_amount", "std_amount", "max_amount")
