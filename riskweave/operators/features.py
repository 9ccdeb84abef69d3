"""Behavioural features per account.

Batch form.  ``limit`` and ``rows`` set from which size on, and how finely, hot accounts are cut
(see :mod:`riskweave.operators.frames`).  Order is (``ts``, ``transaction_id``); ``ts_long`` is the whole second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from riskweave.functions import numbers, times
from riskweave.operators.frames import SLICE_ROWS, apply, distinct, distinct_trailing, over_previous, over_trailing, previous, trailing

KEY = ["account_id"]
ORDER = ["ts", "transaction_id"]
BACK = 10  # fixed value: ten earlier rows, so a frame of eleven
DAY = 86_400


def _rows(df: DataFrame, build, back: int, **cut) -> DataFrame:
    return over_previous(df, KEY, ORDER, back, build, **cut)


def _frame(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(-BACK, 0)


def _z(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (value - mean) / std).otherwise(0.0)


def rolling_mean(df: DataFrame, value: str = "amount", **cut) -> DataFrame:
    return _rows(df, lambda w: {"rolling_mean": F.avg(value).over(_frame(w))}, BACK, **cut)


def rolling_std(df: DataFrame, value: str = "amount", **cut) -> DataFrame:
    return _rows(df, lambda w: {"rolling_std": F.stddev_pop(value).over(_frame(w))}, BACK, **cut)


def amount_z(df: DataFrame, value: str = "amount", **cut) -> DataFrame:
    def build(w: WindowSpec) -> dict[str, Column]:
        mean, std = F.avg(value).over(_frame(w)), F.stddev_pop(value).over(_frame(w))
        return {"amount_z": _z(F.col(value), mean, std)}

    return _rows(df, build, BACK, **cut)


def _changed(w: WindowSpec, column: str) -> Column:
    """1 where the column differs from the previous row's; 0 on the first row and beside nulls."""
    return F.when(F.lag(column).over(w) != F.col(column), 1).otherwise(0)


def new_device(df: DataFrame, **cut) -> DataFrame:
    return _rows(df, lambda w: {"new_device": _changed(w, "device_id")}, 1, **cut)


def time_since_last_tx(df: DataFrame, **cut) -> DataFrame:
    gap = lambda w: F.coalesce(F.col("ts_long") - F.lag("ts_long").over(w), F.lit(0))
    return _rows(df, lambda w: {"time_since_last_tx": gap(w)}, 1, **cut)


def rolling_amount_5m(df: DataFrame, value: str = "amount", seconds: int = 300, **cut) -> DataFrame:
    return over_trailing(df, KEY, "ts_long", {"rolling_amount_5m": ("sum", value, seconds)}, **cut)


def amount_ratio(df: DataFrame, value: str = "amount", seconds: int = 300, **cut) -> DataFrame:
    return rolling_amount_5m(df, value, seconds, **cut).withColumn(
        "amount_ratio", F.col(value) / (F.col("rolling_amount_5m") + F.lit(1e-3))
    )


def transaction_frequency_30min(df: DataFrame, **cut) -> DataFrame:
    return over_trailing(df, KEY, "ts_long", {"transaction_frequency_30min": ("count", None, 1800)}, **cut)


def transactions_last_24h(df: DataFrame, **cut) -> DataFrame:
    return over_trailing(df, KEY, "ts_long", {"transactions_last_24h": ("count", None, DAY)}, **cut)


def avg_transaction_amount_24h(df: DataFrame, value: str = "amount", **cut) -> DataFrame:
    return over_trailing(df, KEY, "ts_long", {"avg_transaction_amount_24h": ("avg", value, DAY)}, **cut)


def unique_receivers_24h(df: DataFrame, **cut) -> DataFrame:
    return distinct_trailing(df, KEY, "ts_long", "receiver_id", DAY, "unique_receivers_24h", **cut)


def login_ip_changed_last_hour(df: DataFrame, seconds: int = 3600, limit: int | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    moved = previous(KEY, ORDER, 1, lambda w: {"_moved": _changed(w, "ip")})
    recent = trailing(KEY, "ts_long", {"login_ip_changed_last_hour": ("max", "_moved", seconds)})
    return apply(df, KEY, ORDER, [moved, recent], limit, rows).drop("_moved")


def stream_vector_features(df: DataFrame, limit: int | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """All columns of the published vector in one pass: rolling mean and std, z, device change, 5-minute sum and ratio."""

    def build(w: WindowSpec) -> dict[str, Column]:
        mean, std = F.avg("amount").over(_frame(w)), F.stddev_pop("amount").over(_frame(w))
        return {
            "rolling_mean": mean,
            "rolling_std": std,
            "amount_z": _z(F.col("amount"), mean, std),
            "new_device": _changed(w, "device_id"),
        }

    steps = [
        previous(KEY, ORDER, BACK, build),
        trailing(KEY, "ts_long", {"rolling_amount_5m": ("sum", "amount", 300)}),
    ]
    out = apply(df, KEY, ORDER, steps, limit, rows)
    return out.withColumns(
        {
            "amount_ratio": F.col("amount") / (F.col("rolling_amount_5m") + F.lit(1e-3)),
            "is_night": times.night_activity(F.col("ts")),
        }
    )


def model_features(df: DataFrame, limit: int | None = None, rows: int = SLICE_ROWS, receivers: bool = False) -> DataFrame:
    """The model's feature columns from raw transactions: one shuffle by account for all ordinary accounts.

    ``receivers`` adds the distinct receivers, which the light score does not read.
    """

    def build(w: WindowSpec) -> dict[str, Column]:
        return {
            "time_since_last_tx": F.coalesce(F.col("ts_long") - F.lag("ts_long").over(w), F.lit(0)),
            "_moved": _changed(w, "ip"),
        }

    frames = {
        "transaction_frequency_30min": ("count", None, 1800),
        "transactions_last_24h": ("count", None, DAY),
        "avg_transaction_amount_24h": ("avg", "amount", DAY),
        "login_ip_changed_last_hour": ("max", "_moved", 3600),
    }
    steps = [previous(KEY, ORDER, 1, build), trailing(KEY, "ts_long", frames)]
    if receivers:
        steps.append(distinct(KEY, "ts_long", "receiver_id", DAY, "unique_receivers_24h"))
    out = apply(df, KEY, ORDER, steps, limit, rows).drop("_moved")
    ts = F.col("ts")
    return out.withColumns(
        {
            "transaction_amount": F.col("amount"),
            "transaction_time_seconds": times.time_seconds(ts),
            "is_weekend": times.is_weekend(ts),
            "hour_of_day": times.hour_of_day(ts),
            "is_round_amount": numbers.is_round_amount(F.col("amount")),
        }
    )


def window_stats(df: DataFrame, size: int = 60, slide: int = 10) -> DataFrame:
    """Mean, population deviation and maximum per account and sliding window, stamped with the window end.

    Works on batch and streaming frames; partial aggregation absorbs hot accounts.
    """
    window = F.window("ts", f"{size} seconds", f"{slide} seconds")
    return (
        df.groupBy(window, "account_id")
        .agg(
            F.avg("amount").alias("avg_amount"),
            F.stddev_pop("amount").alias("std_amount"),
            F.max("amount").alias("max_amount"),
        )
        .select(
            F.unix_timestamp("window.end").alias("window_end"), "account_id", "avg_amount", "std_amount", "max_amount"
        )
    )


def feature_json(df: DataFrame, names: list[str], out: str = "feature_vector") -> DataFrame:
    """Named columns as one JSON object; null fields are left out."""
    return df.withColumn(out, F.to_json(F.struct(*names)))
