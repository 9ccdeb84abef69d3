"""Record types and named feature lists.  Field names, ranges and weights are fixed values of the data contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Streamed transaction record.
TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("channel", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField(
            "geolocation",
            T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
        ),
        T.StructField("behavior_score", T.DoubleType()),
        T.StructField("is_night", T.IntegerType()),
        T.StructField("velocity", T.DoubleType()),
    ]
)

# Model input order (no segment).
MODEL_FEATURES = [
    "transaction_amount",
    "transaction_time_seconds",
    "is_weekend",
    "hour_of_day",
    "location_risk_score",
    "transaction_frequency_30min",
    "login_ip_changed_last_hour",
    "avg_transaction_amount_24h",
    "time_since_last_tx",
    "ip_risk_score",
    "vpn_detected",
    "transactions_last_24h",
    "is_round_amount",
    "unique_receivers_24h",
]

# The older six-feature list.
LEGACY_FEATURES = ["amount", "velocity", "is_night", "country_risk", "new_device", "behavior_deviation"]

# Fields of the published feature vector.
VECTOR_FIELDS = ["amount", "velocity", "is_night", "amount_ratio", "new_device", "behavior_score", "amount_z"]

# Customer segments.
SEGMENTS = ["standard", "premium", "business"]

# Allowed range per feature column, (low, high) inclusive, None = open.
FEATURE_RANGES = {
    "transaction_amount": (0, None),
    "transaction_time_seconds": (0, None),
    "is_weekend": (0, 1),
    "hour_of_day": (0, 23),
    "is_round_amount": (0, 1),
    "unique_receivers_24h": (0, None),
    "vpn_detected": (0, 1),
    "location_risk_score": (0, 1),
    "transaction_frequency_30min": (0, None),
    "login_ip_changed_last_hour": (0, 1),
    "avg_transaction_amount_24h": (0, None),
    "time_since_last_tx": (0, None),
    "ip_risk_score": (0, 1),
    "transactions_last_24h": (0, None),
}

# Blend weights and served thresholds.
BLEND_WEIGHTS = {"tabular": 0.7, "graph": 0.1, "autoencoder": 0.15, "lstm": 0.05}
THRESHOLD = 0.7
REVIEW = 0.6
BLOCK = 0.85

# Fields of a log line.
LOG_FIELDS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "ts",
            "level",
            "service",
            "correlation_id",
            "route",
            "logger",
            "message",
            "decision",
            "score",
            "model_version",
            "hash_verified",
            "sig_verified",
            "user_agent",
        )
    ]
)
