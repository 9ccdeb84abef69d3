"""Joins of transactions with earlier facts of the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.frames import SLICE_ROWS, running_last


def join_stats(tx: DataFrame, stats: DataFrame, size: int = 60, slide: int = 10) -> DataFrame:
    """Left join of transactions with the account's sliding windows that contain them.

    ``stats`` carries ``account_id`` and the window end in epoch seconds as ``window_end``.  A transaction
    lies in ``size / slide`` windows, so the fan-out is fixed; joining on the account alone would pair all
    rows of an account with all its windows.
    """
    first = F.floor(F.col("ts_long") / slide) * slide + slide
    ends = F.explode_outer(F.sequence(first, first + (size - slide), F.lit(slide))).alias("window_end")
    return tx.select("*", ends).join(stats, ["account_id", "window_end"], "left")


def asof_join(
    probes: DataFrame,
    facts: DataFrame,
    key: list[str],
    probe_ts: str,
    fact_ts: str,
    columns: list[str],
    tie: str,
    limit: int | None = None,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add to each probe the ``columns`` of the newest fact of its key at or before its time.

    Union and a running "last seen" instead of a range join: one shuffle, no pairs.  ``tie`` orders facts of
    the same instant, the larger one counts.
    """
    fact = F.struct(*[F.col(c).alias(c) for c in columns])
    left = probes.select(
        *key, F.col(probe_ts).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(facts.schema[tie].dataType).alias("_tie"),
        F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType).alias("_fact"),
        F.struct(*probes.columns).alias("_probe"),
    )
    right = facts.select(
        *key, F.col(fact_ts).alias("_t"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), fact.alias("_fact"),
        F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"),
    )
    both = left.unionByName(right)
    found = running_last(both, key, ["_t", "_kind", "_tie"], "_fact", "_found", limit, rows)
    return found.where("_kind = 1").select("_probe.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def asof_stats(tx: DataFrame, stats: DataFrame, limit: int | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """Newest closed window of the account at or before the transaction."""
    columns = ["window_end", "avg_amount", "std_amount", "max_amount"]
    return asof_join(tx, stats, ["account_id"], "ts_long", "window_end", columns, "window_end", limit, rows)
