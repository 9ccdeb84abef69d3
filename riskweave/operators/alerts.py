"""Alert rules: an expression over metric samples, a bound, and how long it must hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.frames import SLICE_ROWS, apply, last_seen, over_trailing, previous
from riskweave.operators.metrics import SAMPLE_ORDER, counter_increase, growth, histogram_quantile
from riskweave.session import cut as write_table


@dataclass(frozen=True)
class Rule:
    """``kind``: value, increase, rate, max, quantile or ratio; ``metric`` is an anchored regular expression, ``status`` one
    that the sample's ``status`` label has to match, ``over`` the metric of a ratio's denominator."""

    name: str
    metric: str
    kind: str
    op: str
    bound: float
    hold_s: int
    range_s: int = 300
    q: float = 0.95
    status: str = ""
    over: str = ""


# The served rules.
RULES = [
    Rule("BackendHighLatencyP95", "request_latency_ms_bucket", "quantile", ">", 60, 300),
    Rule("InferenceHighLatencyP95", "infer_request_latency_ms_bucket", "quantile", ">", 60, 300),
    Rule("ErrorsSpikeGeneric", "requests_total", "rate", ">", 5, 120, status="5.."),
    Rule("BackendErrorsSpike", "fraud_backend_requests_total", "increase", ">", 5, 120, status="5.."),
    Rule("InferenceErrorsSpike", "fraud_inference_requests_total", "increase", ">", 5, 120, status="5.."),
    Rule("AuthFailures", "auth_failures_total|jwt_failures_total", "increase", ">", 0, 60),
    Rule("ModelIntegrityFailure", "model_integrity_failures_total|model_signature_failures_total|model_decrypt_failures_total", "increase", ">", 0, 60),
    Rule("SafeModeActive", "safe_mode_state", "value", "=", 1, 60),
    Rule("DriftAlert", "drift_alerts_total", "increase", ">", 0, 60, 900),
    Rule("DriftPsiCritical", "psi_feature_.*", "value", ">", 0.3, 300),
    Rule("DriftPsiWarning", "psi_feature_.*", "value", ">", 0.2, 600),
    Rule("KafkaLagHigh", "consumer_group_lag", "max", ">", 10000, 300),
    Rule("RedisEvictions", "redis_evicted_keys_total", "increase", ">", 0, 60),
    Rule("RedisHighMemory", "redis_memory_used_bytes", "ratio", ">", 0.9, 300, over="redis_total_system_memory_bytes"),
    Rule("MongoBatchQueueHigh", "mongo_batch_queue_depth", "value", ">", 5000, 300),
    Rule("MongoBatchDrops", "mongo_batch_dropped_total", "increase", ">", 0, 60),
    Rule("RedisBatchQueueHigh", "redis_batch_queue_depth", "value", ">", 2500, 300),
    Rule("RedisBatchDrops", "redis_batch_dropped_total", "increase", ">", 0, 60),
    Rule("DroppedRequestsSpike", "dropped_requests_total", "increase", ">", 50, 120),
    Rule("InstanceDown", "up", "value", "=", 0, 120),
]

SERIES = ["rule", "name", "series"]


def _expression(samples: DataFrame, kind: str, range_s: int, q: float, **cut) -> DataFrame:
    """Rows ``rule, name, series, ts_long, seq, x`` for the rules of one kind and range."""
    if kind == "value":
        return samples.withColumn("x", F.col("value").cast("double"))
    if kind == "ratio":  # both metrics of a series at one scrape
        part = lambda hit: F.max(F.when(hit, F.col("value").cast("double")))
        both = samples.groupBy("rule", "series", "ts_long").agg(
            F.min("seq").alias("seq"), F.min(F.when(~F.col("below"), F.col("name"))).alias("name"), part(~F.col("below")).alias("up"), part(F.col("below")).alias("down")
        )
        return both.where("up is not null and down is not null and down <> 0").withColumn("x", F.col("up") / F.col("down"))
    if kind == "max":
        return over_trailing(samples, SERIES, "ts_long", {"x": ("max", "value", range_s)}, **cut)
    if kind in ("increase", "rate"):
        grown = counter_increase(samples, SERIES, range_s, "x", **cut)
        return grown.withColumn("x", F.col("x") / float(range_s)) if kind == "rate" else grown
    return _quantiles(samples, range_s, q, **cut)


def _quantiles(samples: DataFrame, range_s: int, q: float, **cut) -> DataFrame:
    """The quantile of the summed growth of all buckets of a rule, at every scrape of any of its series.

    Series need not be scraped together.  Each counter's growth is known at its own samples; what the histogram of all series
    has gained over the range before an instant is the sum of all growth in that range, by edge, whichever series it came
    from.  So growth is added up per edge and second, and one trailing sum per edge runs over the instants of all series.
    A series without a sample in the range adds nothing.
    """
    grown = growth(samples, [*SERIES, "le"], "_up", **cut)
    gains = write_table(grown.groupBy("rule", "le", "ts_long").agg(F.sum("_up").alias("_up")))  # read three times
    edges = gains.select("rule", "le").distinct()
    # one row per instant and edge of the rule: an instant of one series may lack edges that others have
    instants = gains.select("rule", "ts_long").distinct().join(edges, "rule")
    steps = instants.join(gains, ["rule", "le", "ts_long"], "left").withColumn("_up", F.coalesce("_up", F.lit(0.0)))
    steps = write_table(steps)  # read by the panes and by the join with them
    merged = over_trailing(steps, ["rule", "le"], "ts_long", {"value": ("sum", "_up", range_s)}, **cut)
    found = histogram_quantile(merged.drop("_up"), q, ["rule", "ts_long"]).withColumnRenamed("quantile", "x")
    scrapes = samples.groupBy("rule", "ts_long", "seq").agg(F.min("name").alias("name"))
    return scrapes.join(found, ["rule", "ts_long"]).withColumn("series", F.lit(""))


def eval_alerts(samples: DataFrame, rules: list[Rule] = RULES, limit: int | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """State of every rule at every matching sample.

    ``samples``: ``name, series, ts_long, seq, value``, for histogram buckets ``le``, and a ``status`` label where there is one.
    A quantile rule has one state for all its series (``series`` is empty), evaluated at the scrapes of any of them.
    Result: ``rule, name, series, ts_long, seq, x, since, state`` with state ``ok``, ``pending`` or ``firing``;
    ``since`` is the start of the unbroken run of samples over the bound.  Rules of one kind and range share a pass.
    """
    kept = ["rule", "name", "series", "ts_long", "seq", "x"]
    passes: dict[tuple, list[Rule]] = {}
    for rule in rules:
        passes.setdefault((rule.kind, rule.range_s if rule.kind not in ("value", "ratio") else 0, rule.q), []).append(rule)
    parts = []
    for (kind, range_s, q), members in passes.items():
        status = F.coalesce(F.col("status").cast("string"), F.lit("")) if "status" in samples.columns else F.lit("")

        def hit(metric: str, labelled: str):
            named = F.col("name").rlike(f"^(?:{metric})$")
            return named & status.rlike(f"^(?:{labelled})$") if labelled else named

        names = F.filter(
            F.array(
                *[F.when(hit(r.metric, r.status), F.struct(F.lit(r.name).alias("rule"), F.lit(False).alias("below"))) for r in members],
                *[F.when(hit(r.over, r.status), F.struct(F.lit(r.name).alias("rule"), F.lit(True).alias("below"))) for r in members if r.over],
            ),
            lambda r: r.isNotNull(),
        )
        matched = samples.select("*", F.inline(names))
        parts.append(_expression(matched, kind, range_s, q, limit=limit, rows=rows).select(*kept))
    values = parts[0]
    for part in parts[1:]:
        values = values.unionByName(part)
    over, hold = F.lit(False), F.lit(0)
    for r in rules:
        x = F.col("x")
        hit = {">": x > r.bound, ">=": x >= r.bound, "<": x < r.bound, "=": x == r.bound}[r.op]
        over = F.when(F.col("rule") == r.name, F.coalesce(hit, F.lit(False))).otherwise(over)
        hold = F.when(F.col("rule") == r.name, r.hold_s).otherwise(hold)
    # Long series are counted, sampled, sliced and told from the others, each time from here.
    judged = write_table(values.withColumns({"_over": over, "_hold": hold}))

    def starts(w):
        before = F.coalesce(F.lag("_over").over(w), F.lit(False))
        return {"_start": F.when(F.col("_over") & ~before, F.col("ts_long"))}

    ops = [previous(SERIES, SAMPLE_ORDER, 1, starts), last_seen(SERIES, SAMPLE_ORDER, "_start", "_since")]
    held = apply(judged, SERIES, SAMPLE_ORDER, ops, limit, rows)
    since = F.when(F.col("_over"), F.col("_since"))
    state = (
        F.when(~F.col("_over"), "ok").when(F.col("ts_long") - F.col("_since") >= F.col("_hold"), "firing").otherwise("pending")
    )
    return held.select(*kept, since.alias("since"), state.alias("state"))
