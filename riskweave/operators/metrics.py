"""Operational aggregates over request tables and metric samples.

A sample table has ``series`` columns (labels), ``ts_long`` (epoch seconds), an ordering column ``seq`` and
``value``.  Ranges look back from each sample, both ends included; values are not extrapolated to the range
boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskweave.operators.frames import SLICE_ROWS, Op, apply, over_trailing, previous, trailing
from riskweave.operators.ranks import order_statistics

SAMPLE_ORDER = ["ts_long", "seq"]

# Histogram edges in use.
LATENCY_MS = [1, 5, 10, 20, 50, 100, 200]
PAYLOAD_BYTES = [256, 512, 1024, 2048, 4096, 8192, 16384, 65536]


def decision_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("decision", "channel", "model_version").agg(F.count(F.lit(1)).alias("n"))


def request_counts(df: DataFrame) -> DataFrame:
    errors = F.sum((F.col("status") >= 500).cast("bigint"))
    return df.groupBy("method", "path", "status").agg(F.count(F.lit(1)).alias("requests"), errors.alias("errors"))


def histogram(df: DataFrame, col: str, edges: list[float], by: list[str]) -> DataFrame:
    """Cumulative histogram: rows ``by, le, value`` plus the group's ``sum`` and ``count``; the last ``le`` is infinite.

    Each row falls into one bucket, buckets are counted, and only the counts are cumulated.
    """
    bounds = [float(e) for e in sorted(edges)] + [float("inf")]
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col(col) <= bounds[i], i).otherwise(bucket)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, bucket.alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(col).alias("s")
    )
    hits = [F.sum(F.when(F.col("b") <= i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(len(bounds))]
    wide = counts.groupBy(*by).agg(*hits, F.sum("s").alias("sum"), F.sum("n").alias("count"))
    cells = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"c{i}").alias("value")) for i, b in enumerate(bounds)])
    return wide.select(*by, F.explode(cells).alias("x"), "sum", "count").select(*by, "x.le", "x.value", "sum", "count")


def histogram_quantile(hist: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile from cumulative buckets ``by, le, value``, linear inside a bucket.

    A rank in the infinite bucket gives the highest finite edge; an empty histogram gives null.
    """
    spec = W.partitionBy(*by).orderBy("le")
    steps = hist.select(
        *by,
        "le",
        "value",
        F.coalesce(F.lag("le").over(spec), F.lit(0.0)).alias("lo"),
        F.coalesce(F.lag("value").over(spec).cast("double"), F.lit(0.0)).alias("below"),
        F.max("value").over(W.partitionBy(*by)).alias("total"),
    )
    rank = F.col("total") * q
    first = steps.where((F.col("value") >= rank) & (F.col("total") > 0)).groupBy(*by, "total").agg(
        F.min_by(F.struct("le", "lo", "value", "below"), "le").alias("b")
    )
    inside = F.col("b.lo") + (F.col("b.le") - F.col("b.lo")) * F.coalesce(
        F.try_divide(rank - F.col("b.below"), F.col("b.value") - F.col("b.below")), F.lit(1.0)
    )
    return first.select(*by, F.when(F.col("b.le") == float("inf"), F.col("b.lo")).otherwise(inside).alias("quantile"))


def _grown(column: str, w: WindowSpec) -> Column:
    before = F.lag(column).over(w)
    up = F.when(F.col(column) >= before, F.col(column) - before).otherwise(F.col(column))
    return F.when(before.isNull(), 0.0).otherwise(up.cast("double"))


def _steps(series: list[str], columns: dict[str, str]) -> Op:
    """Growth of each counter column since the previous sample, under the given new name."""
    return previous(series, SAMPLE_ORDER, 1, lambda w: {new: _grown(c, w) for c, new in columns.items()})


def growth(samples: DataFrame, series: list[str], out: str, limit: int | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``out``: what a counter gained since the sample before; a drop means a restart from zero."""
    return apply(samples, series, SAMPLE_ORDER, [_steps(series, {"value": out})], limit, rows)


def counter_increase(
    samples: DataFrame, series: list[str], range_s: int, out: str = "increase", limit: int | None = None, rows: int = SLICE_ROWS
) -> DataFrame:
    """Growth of a counter over the trailing range; a drop means a restart from zero."""
    ops = [_steps(series, {"value": "_grown"}), trailing(series, "ts_long", {out: ("sum", "_grown", range_s)})]
    return apply(samples, series, SAMPLE_ORDER, ops, limit, rows).drop("_grown")


def counter_rate(samples: DataFrame, series: list[str], range_s: int, **cut) -> DataFrame:
    grown = counter_increase(samples, series, range_s, "rate", **cut)
    return grown.withColumn("rate", F.col("rate") / F.lit(float(range_s)))


def error_ratio(df: DataFrame, by: list[str], range_s: int, **cut) -> DataFrame:
    """Share of 5xx among the requests of the trailing range, per request."""
    flagged = df.withColumn("_err", (F.col("status") >= 500).cast("double"))
    frames = {"_bad": ("sum", "_err", range_s), "_all": ("count", None, range_s)}
    out = over_trailing(flagged, by, "ts_long", frames, **cut)
    return out.withColumn("error_ratio", F.try_divide("_bad", "_all")).drop("_err", "_bad", "_all")


def mean_from_counters(
    samples: DataFrame, series: list[str], sum_col: str, count_col: str, range_s: int, limit: int | None = None, rows: int = SLICE_ROWS
) -> DataFrame:
    """Mean over the trailing range from a sum counter and a count counter; null where nothing was counted."""
    frames = {"_rs": ("sum", "_ds", range_s), "_rc": ("sum", "_dc", range_s)}
    ops = [_steps(series, {sum_col: "_ds", count_col: "_dc"}), trailing(series, "ts_long", frames)]
    out = apply(samples, series, SAMPLE_ORDER, ops, limit, rows)
    return out.withColumn("mean", F.try_divide("_rs", "_rc")).drop("_ds", "_dc", "_rs", "_rc")


def max_over_time(samples: DataFrame, series: list[str], range_s: int, **cut) -> DataFrame:
    return over_trailing(samples, series, "ts_long", {"max_over_time": ("max", "value", range_s)}, **cut)


def run_summary(df: DataFrame) -> DataFrame:
    """One row for a load run: totals, rate, mean latency and floor-index percentiles, rounded to 2 digits."""
    spent = (F.max("ts_long") - F.min("ts_long")).cast("double")
    totals = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col("status") == 200).cast("bigint")).alias("ok"),
        F.sum((F.col("decision") == "FRAUD").cast("bigint")).alias("fraud"),
        F.sum((~F.coalesce(F.col("status") == 200, F.lit(False))).cast("bigint")).alias("errors"),
        F.round(F.when(spent > 0, F.count(F.lit(1)) / spent).otherwise(0.0), 2).alias("req_per_sec"),
        F.round(F.avg("duration_ms"), 2).alias("latency_avg_ms"),
    )
    at = lambda p: (p, lambda n: F.least(n - 1, F.floor(n * F.lit(p))))
    marks = order_statistics(df, "duration_ms", {"p50": at(0.5), "p95": at(0.95)})
    # Both sides are single rows.
    return totals.crossJoin(F.broadcast(marks)).select(
        *totals.columns, F.round("p50", 2).alias("latency_p50_ms"), F.round("p95", 2).alias("latency_p95_ms")
    )


def tally(df: DataFrame) -> DataFrame:
    """Counts of FRAUD, NORMAL and ERROR (no 200 or no decision); classes without rows count 0."""
    answered = F.coalesce((F.col("status") == 200) & F.col("decision").isin("FRAUD", "NORMAL"), F.lit(False))
    outcome = F.when(answered, F.col("decision")).otherwise("ERROR")
    sums = [F.coalesce(F.sum((outcome == c).cast("bigint")), F.lit(0).cast("bigint")).alias(c) for c in ("FRAUD", "NORMAL", "ERROR")]
    cells = [F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in ("FRAUD", "NORMAL", "ERROR")]
    return df.agg(*sums).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def cpu_pct(samples: DataFrame, instance: list[str], range_s: int, **cut) -> DataFrame:
    """Busy share from idle-second counters per instance and core: ``100 - 100 * mean idle rate``."""
    rates = counter_rate(samples, [*instance, "cpu"], range_s, **cut)
    return rates.groupBy(*instance, "ts_long").agg((F.lit(100.0) - F.avg("rate") * 100.0).alias("cpu_pct"))


def mem_pct(samples: DataFrame) -> DataFrame:
    """Used share from total and available gauges in one row per instance and time."""
    free = F.try_divide(F.col("available").cast("double"), F.col("total"))
    return samples.withColumn("mem_pct", (F.lit(1.0) - free) * 100.0)


def sum_by(samples: DataFrame, labels: list[str], value: str = "value") -> DataFrame:
    return samples.groupBy(*labels).agg(F.sum(value).alias("sum"))


def health_rollup(df: DataFrame) -> DataFrame:
    """Per snapshot ``ok`` when every dependency is ok, else ``degraded``."""
    healthy = F.bool_and(F.coalesce(F.col("ok"), F.lit(False)))
    return df.groupBy("snapshot").agg(F.when(healthy, "ok").otherwise("degraded").alias("status"))


def series_or(left: DataFrame, right: DataFrame, labels: list[str]) -> DataFrame:
    """Union of two series sets; on equal labels the left one wins."""
    return left.unionByName(right.join(left.select(*labels).distinct(), labels, "left_anti"))


def missing_series(expected: DataFrame, observed: DataFrame) -> DataFrame:
    return expected.select("name").subtract(observed.select("name"))


def has_roles(granted: Column, required: list[str]) -> Column:
    need = F.array(*[F.lit(r) for r in required])
    return F.size(F.array_except(need, F.coalesce(granted, F.array().cast("array<string>")))) == 0
