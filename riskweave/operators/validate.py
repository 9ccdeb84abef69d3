"""Row constraints, closed schemas, defaults, model-input projection, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.schema import FEATURE_RANGES, SEGMENTS


def range_rules(ranges: dict[str, tuple[float | None, float | None]]) -> dict[str, Column]:
    """Boolean rule per column; a missing value breaks it."""
    rules = {}
    for name, (low, high) in ranges.items():
        ok = F.col(name).isNotNull()
        if low is not None:
            ok = ok & (F.col(name) >= low)
        if high is not None:
            ok = ok & (F.col(name) <= high)
        rules[name] = ok
    return rules


def feature_rules() -> dict[str, Column]:
    rules = range_rules(FEATURE_RANGES)
    rules["customer_segment"] = F.coalesce(F.col("customer_segment").isin(SEGMENTS), F.lit(False))
    return rules


def transaction_rules() -> dict[str, Column]:
    return {
        "transaction_id": F.col("transaction_id").isNotNull(),
        "account_id": F.col("account_id").isNotNull(),
        "amount": F.coalesce((F.col("amount") > 0) & ~F.isnan("amount"), F.lit(False)),
    }


def validate(df: DataFrame, rules: dict[str, Column], out: str = "violations") -> DataFrame:
    """Add the names of the broken rules; an empty list means the row is good."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn(out, F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def reject_extra(df: DataFrame, json_col: str, allowed: list[str]) -> DataFrame:
    """Add ``extra_fields``: object keys outside ``allowed`` (null where the text is no JSON object)."""
    keys = F.json_object_keys(F.col(json_col))
    return df.withColumn("extra_fields", F.array_sort(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))))


def apply_defaults(df: DataFrame, currency: str = "EUR", channel: str = "unknown") -> DataFrame:
    return df.withColumns(
        {
            "currency": F.coalesce("currency", F.lit(currency)),
            "channel": F.coalesce("channel", F.lit(channel)),
            "ts": F.coalesce("ts", F.current_timestamp()),
        }
    )


def vectorize(df: DataFrame, names: list[str], out: str = "vector") -> DataFrame:
    """Ordered feature array; a missing value or column counts as 0.0."""
    have = set(df.columns)
    cells = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in have else F.lit(0.0) for n in names]
    return df.withColumn(out, F.array(*cells))


def model_frame(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Exactly the model's columns next to ``keep``; absent ones are null, others are dropped."""
    have = set(df.columns)
    cells = [F.col(n).cast("double").alias(n) if n in have else F.lit(None).cast("double").alias(n) for n in names]
    return df.select(*keep, *cells)


def route_dlq(df: DataFrame, ok: Column, reason: Column, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to publish, dead letters with reason and time); a null verdict is a failure."""
    good = F.coalesce(ok, F.lit(False))
    at = F.unix_micros(F.current_timestamp()) / 1e6 if at is None else at
    return df.where(good), df.where(~good).withColumns({"dlq_reason": reason, "dlq_ts": at})
