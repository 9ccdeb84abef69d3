"""Evaluation, drift, counters, histograms, alerts and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import alerts, drift, evaluate, logs, metrics
from riskweave.plans.registry import query
from riskweave.plans.views import COUNTERS, DRIFT_BASE, REQUESTS, SCORED, TX, counters, cut_all, drift_base, requests, scored, tx, with_sql
from riskweave.sources.tables import table

DAY = 86_400


# Counts.
@query(
    "a2_decision_counts",
    with_sql(
        TX,
        body="""SELECT CASE WHEN amount >= 60 THEN 'FRAUD' ELSE 'NORMAL' END AS decision, channel, concat('v', CAST(k % 3 AS VARCHAR)) AS model_version,
  count(*) AS n FROM tx GROUP BY ALL""",
    ),
)
def decision_counts(spark, sf):
    t = tx(spark, sf).withColumns(
        {
            "decision": F.when(F.col("amount") >= 60, "FRAUD").otherwise("NORMAL"),
            "model_version": F.concat(F.lit("v"), (F.col("k") % 3).cast("string")),
        }
    )
    return metrics.decision_counts(t)


@query(
    "a3_request_counts",
    with_sql(
        TX, REQUESTS,
        body="""SELECT method, path, status, count(*) AS requests, CAST(sum(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS BIGINT) AS errors
  FROM requests GROUP BY method, path, status""",
    ),
)
def request_counts(spark, sf):
    return metrics.request_counts(requests(spark, sf))


BUCKETS = """edges AS (SELECT unnest([1, 5, 10, 20, 50, 100, 200, 'inf'::DOUBLE]) AS le),
hist AS (SELECT path, service, le, CAST(sum(CASE WHEN latency_ms <= le THEN 1 ELSE 0 END) AS BIGINT) AS value, sum(latency_ms) AS sum, count(*) AS count
  FROM requests, edges GROUP BY path, service, le)"""


@query(
    "a4_histogram",
    with_sql(
        TX, REQUESTS, BUCKETS,
        body="SELECT path, service, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS BIGINT) AS VARCHAR) END AS le, value, round(sum, 4) AS sum, count FROM hist",
    ),
)
def histogram(spark, sf):
    h = metrics.histogram(requests(spark, sf), "latency_ms", metrics.LATENCY_MS, ["path", "service"])
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("bigint").cast("string"))
    return h.select("path", "service", le.alias("le"), "value", F.round("sum", 4).alias("sum"), "count")


QUANTILE = """steps AS (
  SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(value) OVER w, 0) AS below, {q} * max(value) OVER (PARTITION BY {by}) AS rank
  FROM hist WINDOW w AS (PARTITION BY {by} ORDER BY le)),
first AS (SELECT * FROM steps WHERE value >= rank AND rank > 0 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY le) = 1)"""
QUANTILE_VALUE = "CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rank - below) / (value - below) END"


def quantile_query(name: str, q: float):
    @query(
        name,
        with_sql(
            TX, REQUESTS, BUCKETS, QUANTILE.format(q=f"{q}::DOUBLE", by="path, service"),
            body=f"SELECT path, service, round({QUANTILE_VALUE}, 6) AS quantile FROM first",
        ),
    )
    def run(spark, sf):
        h = metrics.histogram(requests(spark, sf), "latency_ms", metrics.LATENCY_MS, ["path", "service"])
        out = metrics.histogram_quantile(h, q, ["path", "service"])
        return out.select("path", "service", F.round("quantile", 6).alias("quantile"))


quantile_query("a5_histogram_quantile_p95", 0.95)
quantile_query("a5_histogram_quantile_p50", 0.5)

GROWN = """grown AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w ELSE value END AS g
  FROM counters WINDOW w AS (PARTITION BY name ORDER BY ts_long, seq))"""


def ago(by: str, seconds: int) -> str:
    return f"(PARTITION BY {by} ORDER BY ts_long RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)"


INCREASE_SQL = with_sql(TX, COUNTERS, GROWN, body=f"SELECT name, seq, CAST(sum(g) OVER {ago('name', DAY)} AS DOUBLE) AS increase FROM grown")


@query("a6_counter_increase", INCREASE_SQL)
def counter_increase(spark, sf):
    return metrics.counter_increase(counters(spark, sf), ["name"], DAY).select("name", "seq", "increase")


@query("a6_counter_increase_cut_series", INCREASE_SQL)
def counter_increase_cut(spark, sf):
    """The same with the five series cut into slices and panes."""
    return metrics.counter_increase(counters(spark, sf), ["name"], DAY, **cut_all(spark, sf)).select("name", "seq", "increase")


@query("a6_counter_rate", with_sql(TX, COUNTERS, GROWN, body=f"SELECT name, seq, round(sum(g) OVER {ago('name', DAY)} / 86400.0::DOUBLE, 9) AS rate FROM grown"))
def counter_rate(spark, sf):
    return metrics.counter_rate(counters(spark, sf), ["name"], DAY).select("name", "seq", F.round("rate", 9).alias("rate"))


@query(
    "a7_error_ratio",
    with_sql(
        TX, REQUESTS,
        body=f"""SELECT event_id, round(sum(CASE WHEN status >= 500 THEN 1 ELSE 0 END) OVER {ago('service', 7200)}::DOUBLE
  / count(*) OVER {ago('service', 7200)}, 6) AS error_ratio FROM requests""",
    ),
)
def error_ratio(spark, sf):
    out = metrics.error_ratio(requests(spark, sf), ["service"], 7200)
    return out.select("event_id", F.round("error_ratio", 6).alias("error_ratio"))


@query(
    "a8_mean_from_counters",
    with_sql(
        TX, COUNTERS,
        """pair AS (SELECT name, ts_long, seq, value * 3 + value % 7 AS total, value AS n FROM counters)""",
        """steps AS (SELECT *, CASE WHEN lag(total) OVER w IS NULL THEN 0 WHEN total >= lag(total) OVER w THEN total - lag(total) OVER w ELSE total END AS dt,
  CASE WHEN lag(n) OVER w IS NULL THEN 0 WHEN n >= lag(n) OVER w THEN n - lag(n) OVER w ELSE n END AS dn
  FROM pair WINDOW w AS (PARTITION BY name ORDER BY ts_long, seq))""",
        body=f"""SELECT name, seq, round(CASE WHEN sum(dn) OVER {ago('name', 7200)} = 0 THEN NULL
  ELSE (sum(dt) OVER {ago('name', 7200)})::DOUBLE / sum(dn) OVER {ago('name', 7200)} END, 6) AS mean FROM steps""",
    ),
)
def mean_from_counters(spark, sf):
    c = counters(spark, sf).withColumns({"total": F.col("value") * 3 + F.col("value") % 7, "n": F.col("value")})
    out = metrics.mean_from_counters(c, ["name"], "total", "n", 7200)
    return out.select("name", "seq", F.round("mean", 6).alias("mean"))


@query("a9_max_over_time", with_sql(TX, body=f"SELECT event_id, max(amount) OVER {ago('channel', 14400)} AS max_over_time FROM tx"))
def max_over_time(spark, sf):
    g = tx(spark, sf).withColumn("value", F.col("amount"))
    return metrics.max_over_time(g, ["channel"], 14_400).select("event_id", "max_over_time")


def run_table(spark, sf):
    decision = F.when(F.col("k") % 9 == 0, F.lit(None)).when(F.col("amount") >= 60, "FRAUD").otherwise("NORMAL")
    r = requests(spark, sf).withColumnRenamed("latency_ms", "amount")
    return r.withColumns({"decision": decision, "duration_ms": F.when(F.col("k") % 6 != 0, F.col("amount"))})


RUN = """run AS (SELECT *, CASE WHEN k % 9 = 0 THEN NULL WHEN latency_ms >= 60 THEN 'FRAUD' ELSE 'NORMAL' END AS decision,
  CASE WHEN k % 6 <> 0 THEN latency_ms END AS duration_ms FROM requests)"""


@query(
    "a10_run_summary",
    with_sql(
        TX, REQUESTS, RUN,
        """sorted AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) - 1 AS i, count(*) OVER () AS n FROM run WHERE duration_ms IS NOT NULL)""",
        body="""SELECT count(*) AS total, CAST(sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) AS BIGINT) AS ok,
  CAST(sum(CASE WHEN decision = 'FRAUD' THEN 1 ELSE 0 END) AS BIGINT) AS fraud, CAST(sum(CASE WHEN status = 200 THEN 0 ELSE 1 END) AS BIGINT) AS errors,
  round(count(*) / (max(ts_long) - min(ts_long))::DOUBLE, 2) AS req_per_sec, round(avg(duration_ms), 2) AS latency_avg_ms,
  (SELECT round(max(duration_ms), 2) FROM sorted WHERE i = CAST(floor(n * 0.5::DOUBLE) AS BIGINT)) AS latency_p50_ms,
  (SELECT round(max(duration_ms), 2) FROM sorted WHERE i = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) AS latency_p95_ms FROM run""",
    ),
)
def run_summary(spark, sf):
    return metrics.run_summary(run_table(spark, sf))


@query(
    "a11_tally",
    with_sql(
        TX, REQUESTS, RUN,
        body="""SELECT o.outcome, count(run.event_id) AS n FROM (VALUES ('FRAUD'), ('NORMAL'), ('ERROR')) o(outcome)
  LEFT JOIN run ON o.outcome = CASE WHEN status = 200 AND decision IS NOT NULL THEN decision ELSE 'ERROR' END GROUP BY o.outcome""",
    ),
)
def tally(spark, sf):
    return metrics.tally(run_table(spark, sf))


# Evaluation.
def report_query(name: str, beta: int):
    @query(
        name,
        with_sql(
            TX, SCORED,
            f"""c AS (SELECT class, CAST(sum(CASE WHEN y = class AND p5 = class THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
    CAST(sum(CASE WHEN p5 = class THEN 1 ELSE 0 END) AS DOUBLE) AS pp, CAST(sum(CASE WHEN y = class THEN 1 ELSE 0 END) AS BIGINT) AS support
  FROM (SELECT y, CAST(p >= 0.5::DOUBLE AS INTEGER) AS p5 FROM scored) s, (VALUES (0), (1)) k(class) GROUP BY class)""",
            body=f"""SELECT class, round(tp / pp, 6) AS precision, round(tp / support, 6) AS recall,
  round({1 + beta * beta}.0::DOUBLE * (tp / pp) * (tp / support) / ({beta * beta}.0::DOUBLE * (tp / pp) + tp / support), 6) AS f_beta, support FROM c""",
        ),
    )
    def run(spark, sf):
        s = scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
        out = evaluate.class_report(s, "y", "pred", beta)
        return out.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f_beta")])


report_query("a12_class_report_f1", 1)
report_query("a12_class_report_f2", 2)


@query(
    "a13_roc_auc",
    with_sql(
        TX, SCORED,
        """g AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM scored GROUP BY p)""",
        """r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)""",
        body="SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 8) AS auc FROM r",
    ),
)
def roc_auc(spark, sf):
    return evaluate.roc_auc(scored(spark, sf), "y", "p").select(F.round("auc", 8).alias("auc"))


SWEEP = """grid AS (SELECT CAST(i AS INTEGER) AS i, 0.1::DOUBLE + i * 0.01::DOUBLE AS threshold FROM range(81) r(i)),
swept AS (SELECT i, threshold, CAST(sum(CASE WHEN p >= threshold AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN p >= threshold AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN p < threshold AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM scored, grid GROUP BY i, threshold)"""


@query("j5_sweep", with_sql(TX, SCORED, SWEEP, body="SELECT i, round(threshold, 4) AS threshold, tp, fp, fn FROM swept"))
def sweep(spark, sf):
    return evaluate.sweep(scored(spark, sf), "y", "p").withColumn("threshold", F.round("threshold", 4))


@query(
    "a14_optimal_threshold",
    with_sql(
        TX, SCORED, SWEEP,
        body="""SELECT round(threshold, 6) AS threshold, round(s, 6) AS score FROM (SELECT threshold,
    0.5::DOUBLE * coalesce(2 * pr * re / nullif(pr + re, 0), 0) + 0.25::DOUBLE * pr + 0.25::DOUBLE * re AS s FROM
    (SELECT threshold, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS pr, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS re FROM swept) x) z
  ORDER BY z.s DESC, threshold LIMIT 1""",
    ),
)
def optimal_threshold(spark, sf):
    out = evaluate.optimal_threshold(scored(spark, sf), "y", "p")
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("score", 6).alias("score"))


@query(
    "a15_label_by_quantile",
    with_sql(
        TX,
        body="""SELECT transaction_id, CAST(amount > (SELECT quantile_cont(amount, 0.95) FROM tx) AND k % 2 = 1 AS INTEGER) AS label,
  CAST(amount > (SELECT quantile_cont(amount, 0.7) FROM tx) AS INTEGER) AS upper FROM tx""",
    ),
)
def label_by_quantile(spark, sf):
    t = evaluate.label_by_quantile(tx(spark, sf), "amount", 0.95, F.col("k") % 2 == 1)
    return evaluate.label_by_quantile(t, "amount", 0.7, out="upper").select("transaction_id", "label", "upper")


@query(
    "a16_label_by_rule",
    with_sql(TX, body="SELECT transaction_id, CAST(amount * 20 > 1500 AND hour(ts) < 6 AND location_risk_score > 0.7::DOUBLE AS INTEGER) AS label FROM tx"),
)
def label_by_rule(spark, sf):
    t = tx(spark, sf).withColumns({"amount": F.col("amount") * 20, "hour_of_day": F.hour("ts")})
    return evaluate.label_by_rule(t).select("transaction_id", "label")


@query(
    "a19_fit_scaler",
    """SELECT round(avg(l_quantity), 4) AS quantity_mean, round(stddev_pop(l_quantity), 6) AS quantity_std, round(avg(l_extendedprice), 4) AS price_mean,
  round(stddev_pop(l_extendedprice), 4) AS price_std, 1.0::DOUBLE AS one_mean, 1.0::DOUBLE AS one_std FROM lineitem""",
)
def fit_scaler(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("one", F.lit(1.0))
    s = evaluate.fit_scaler(li, ["l_quantity", "l_extendedprice", "one"])
    return s.select(
        F.round("l_quantity_mean", 4).alias("quantity_mean"), F.round("l_quantity_std", 6).alias("quantity_std"),
        F.round("l_extendedprice_mean", 4).alias("price_mean"), F.round("l_extendedprice_std", 4).alias("price_std"), "one_mean", "one_std",
    )


@query(
    "a19_scale",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 5) AS quantity
  FROM lineitem""",
)
def scale(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"))
    out = evaluate.scale(li, evaluate.fit_scaler(li, ["quantity"]), ["quantity"])
    return out.withColumn("quantity", F.round("quantity", 5))


# Drift.
OBSERVED = """long AS (SELECT 'amount' AS feature, amount AS v FROM tx UNION ALL SELECT 'k', CASE WHEN k % 8 = 0 THEN NULL ELSE k END FROM tx),
obs AS (SELECT b.feature, b.bin, count(*) AS n FROM long JOIN drift_base b ON long.feature = b.feature AND v >= lo AND (v < hi OR bin = 3) GROUP BY ALL)"""


def observed(spark, sf):
    return tx(spark, sf).select("amount", F.when(F.col("k") % 8 != 0, F.col("k")).alias("k"))


@query("a17_bin_counts", with_sql(TX, DRIFT_BASE, OBSERVED, body="SELECT feature, bin, n FROM obs"))
def bin_counts(spark, sf):
    return drift.bin_counts(observed(spark, sf), drift_base(spark))


@query(
    "j4_join_bins",
    with_sql(
        TX, DRIFT_BASE, OBSERVED,
        body="SELECT feature, bin, lo, hi, expected, coalesce(n, 0) AS n FROM drift_base LEFT JOIN obs USING (feature, bin)",
    ),
)
def join_bins(spark, sf):
    obs = drift.bin_counts(observed(spark, sf), drift_base(spark))
    return drift.join_bins(obs, drift_base(spark))


@query(
    "a18_psi",
    with_sql(
        TX, DRIFT_BASE, OBSERVED,
        """shares AS (SELECT feature, greatest(expected, 1e-6::DOUBLE) AS e,
    greatest(coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY feature), 1e-6::DOUBLE) AS o FROM drift_base LEFT JOIN obs USING (feature, bin))""",
        body="""SELECT feature, round(psi, 8) AS psi, CASE WHEN psi >= 0.3::DOUBLE THEN 'crit' WHEN psi >= 0.2::DOUBLE THEN 'warn' ELSE 'ok' END AS severity
  FROM (SELECT feature, sum((o - e) * ln(o / e)) AS psi FROM shares GROUP BY feature) x""",
    ),
)
def psi(spark, sf):
    return drift.psi(observed(spark, sf), drift_base(spark)).withColumn("psi", F.round("psi", 8))


# Gauges and health.
@query(
    "a20_cpu_pct",
    with_sql(
        TX,
        "counters AS (SELECT channel AS name, user_id % 2 AS cpu, ts_long, event_id AS seq, (event_id % 500) * 100 AS value FROM tx)",
        GROWN.replace("PARTITION BY name", "PARTITION BY name, cpu"),
        body=f"""SELECT name, ts_long, round(100 - 100 * avg(rate), 6) AS cpu_pct FROM
  (SELECT name, ts_long, sum(g) OVER {ago('name, cpu', DAY)} / 86400.0::DOUBLE AS rate FROM grown) r GROUP BY name, ts_long""",
    ),
)
def cpu_pct(spark, sf):
    c = counters(spark, sf).withColumns({"cpu": F.col("user_id") % 2, "value": F.col("value") * 100})
    return metrics.cpu_pct(c, ["name"], DAY).withColumn("cpu_pct", F.round("cpu_pct", 6))


@query("a20_mem_pct", with_sql(TX, body="SELECT event_id, round((1 - k::DOUBLE / 128) * 100, 6) AS mem_pct FROM tx"))
def mem_pct(spark, sf):
    t = tx(spark, sf).select("event_id", F.col("k").alias("available"), F.lit(128).alias("total"))
    return metrics.mem_pct(t).select("event_id", F.round("mem_pct", 6).alias("mem_pct"))


@query("a20_sum_by", with_sql(TX, body="SELECT channel, device_id, CAST(sum(k) AS BIGINT) AS sum FROM tx GROUP BY ALL"))
def sum_by(spark, sf):
    return metrics.sum_by(tx(spark, sf), ["channel", "device_id"], "k")


@query(
    "a21_health_rollup",
    with_sql(TX, body="SELECT ts_long // 3600 AS snapshot, CASE WHEN bool_and(k <> 7) THEN 'ok' ELSE 'degraded' END AS status FROM tx GROUP BY 1"),
)
def health_rollup(spark, sf):
    t = tx(spark, sf).select(F.floor(F.col("ts_long") / 3600).alias("snapshot"), (F.col("k") != 7).alias("ok"))
    return metrics.health_rollup(t)


# Logs.
@query(
    "f17_parse_log",
    with_sql(
        TX, REQUESTS,
        body="""SELECT event_id, concat('request ', CAST(k AS VARCHAR)) AS message, CAST(correlation_id AS VARCHAR) AS correlation_id, service, path AS route,
  CASE WHEN status >= 500 THEN 'error' ELSE 'info' END AS level, CAST(k AS VARCHAR) AS extra FROM requests""",
    ),
)
def parse_log(spark, sf):
    r = requests(spark, sf)
    line = F.to_json(
        F.struct(
            F.concat(F.lit("request "), F.col("k").cast("string")).alias("message"),
            F.col("correlation_id").cast("string").alias("correlation_id"),
            "service",
            F.col("path").alias("route"),
            F.when(F.col("status") >= 500, "error").otherwise("info").alias("level"),
            F.col("k").alias("region"),
        )
    )
    parsed = logs.parse_log(r.select("event_id", line.alias("line")), "line")
    return parsed.select("event_id", "message", F.col("labels")["correlation_id"].alias("correlation_id"), "service", "route", "level", F.col("rest")["region"].alias("extra"))


# Alerts.
ALERTS = [
    alerts.Rule("ErrorsSpike", "error|purchase", "increase", ">", 450, 3600, 7200),
    alerts.Rule("ViewRate", "view", "rate", ">", 0.04, 1800, 7200),
    alerts.Rule("ClickPeak", "click", "max", ">", 480, 7200, 3600),
    alerts.Rule("SignupHigh", "sign.*", "value", ">", 150, 3600),
]
ALERT_SQL = with_sql(
    TX, COUNTERS, GROWN,
    f"""x AS (
  SELECT 'ErrorsSpike' AS rule, name, ts_long, seq, sum(g) OVER {ago('name', 7200)}::DOUBLE AS x, 450 AS bound, 3600 AS hold FROM grown WHERE name IN ('error', 'purchase')
  UNION ALL SELECT 'ViewRate', name, ts_long, seq, sum(g) OVER {ago('name', 7200)} / 7200.0::DOUBLE, 0.04, 1800 FROM grown WHERE name = 'view'
  UNION ALL SELECT 'ClickPeak', name, ts_long, seq, max(value) OVER {ago('name', 3600)}::DOUBLE, 480, 7200 FROM grown WHERE name = 'click'
  UNION ALL SELECT 'SignupHigh', name, ts_long, seq, value::DOUBLE, 150, 3600 FROM grown WHERE name = 'signup')""",
    """judged AS (SELECT *, x > bound AS over, coalesce(lag(x > bound) OVER (PARTITION BY rule, name ORDER BY ts_long, seq), false) AS was FROM x)""",
    """runs AS (SELECT *, last_value(CASE WHEN over AND NOT was THEN ts_long END IGNORE NULLS) OVER (PARTITION BY rule, name ORDER BY ts_long, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM judged)""",
    body="""SELECT rule, name, seq, round(x, 6) AS x, CASE WHEN over THEN since END AS since,
  CASE WHEN NOT over THEN 'ok' WHEN ts_long - since >= hold THEN 'firing' ELSE 'pending' END AS state FROM runs""",
)


def evaluated(spark, sf, **cut):
    samples = counters(spark, sf).withColumn("series", F.lit("all"))
    out = alerts.eval_alerts(samples, ALERTS, **cut)
    return out.select("rule", "name", "seq", F.round("x", 6).alias("x"), "since", "state")


@query("x9_eval_alerts", ALERT_SQL)
def eval_alerts(spark, sf):
    return evaluated(spark, sf)


@query("x9_eval_alerts_cut_series", ALERT_SQL)
def eval_alerts_cut(spark, sf):
    """The same with the series cut into slices and panes."""
    return evaluated(spark, sf, **cut_all(spark, sf))


# Latency buckets: cumulative counters per scrape, slower in every other block of 1,000 ids.
LE = {"50": (3, 1), "100": (6, 2), "200": (8, 7), "inf": (10, 10)}


def latency_samples(spark, sf):
    t = tx(spark, sf)
    slow = F.floor(F.col("event_id") / 1000) % 2 == 1
    done, left = F.floor(F.col("event_id") / 1000), F.col("event_id") % 1000
    cells = []
    for le, (fast, late) in LE.items():
        per_block = F.floor(done / 2) * (fast + late) + F.when(slow, fast).otherwise(0)
        value = per_block * 1000 + F.when(slow, late).otherwise(fast) * left
        cells.append(F.struct(F.lit(float(le)).alias("le"), value.alias("value")))
    long = t.select("ts_long", F.col("event_id").alias("seq"), F.explode(F.array(*cells)).alias("c"))
    return long.select(F.lit("request_latency_ms").alias("name"), F.lit("all").alias("series"), "ts_long", "seq", "c.le", "c.value")


@query(
    "x9_latency_quantile_alert",
    with_sql(
        TX,
        """cells AS (SELECT ts_long, event_id AS seq, le::DOUBLE AS le, ((event_id // 1000) // 2 * (fast + late) + CASE WHEN event_id // 1000 % 2 = 1 THEN fast ELSE 0 END) * 1000
    + CASE WHEN event_id // 1000 % 2 = 1 THEN late ELSE fast END * (event_id % 1000) AS value
  FROM tx, (VALUES ('50', 3, 1), ('100', 6, 2), ('200', 8, 7), ('inf', 10, 10)) b(le, fast, late))""",
        """steps0 AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY le ORDER BY ts_long, seq), 0) AS g FROM cells)""",
        f"""hist AS (SELECT ts_long, seq, le, sum(g) OVER {ago('le', 3600)} AS value FROM steps0)""",
        QUANTILE.format(q="0.95::DOUBLE", by="ts_long, seq"),
        f"""judged AS (SELECT ts_long, seq, {QUANTILE_VALUE} AS x FROM first)""",
        """marks AS (SELECT *, x > 180 AS over, coalesce(lag(x > 180) OVER (ORDER BY ts_long, seq), false) AS was FROM judged)""",
        """runs AS (SELECT *, last_value(CASE WHEN over AND NOT was THEN ts_long END IGNORE NULLS) OVER (ORDER BY ts_long, seq ROWS UNBOUNDED PRECEDING) AS since FROM marks)""",
        body="SELECT seq, round(x, 4) AS x, CASE WHEN NOT over THEN 'ok' WHEN ts_long - since >= 7200 THEN 'firing' ELSE 'pending' END AS state FROM runs",
    ),
)
def latency_alert(spark, sf):
    rule = alerts.Rule("HighLatencyP95", "request_latency_ms", "quantile", ">", 180, 7200, 3600, 0.95)
    return alerts.eval_alerts(latency_samples(spark, sf), [rule]).select("seq", F.round("x", 4).alias("x"), "state")


STAGGERED = 3  # instances that are scraped in turn


def staggered_samples(spark, sf):
    """The same counters from several instances, each scraped at its own events only."""
    return latency_samples(spark, sf).withColumn("series", F.concat(F.lit("i"), (F.col("seq") % STAGGERED).cast("string")))


@query(
    "x9_latency_quantile_alert_staggered",
    with_sql(
        TX,
        f"""cells AS (SELECT ts_long, event_id AS seq, event_id % {STAGGERED} AS series, le::DOUBLE AS le, ((event_id // 1000) // 2 * (fast + late) + CASE WHEN event_id // 1000 % 2 = 1 THEN fast ELSE 0 END) * 1000
    + CASE WHEN event_id // 1000 % 2 = 1 THEN late ELSE fast END * (event_id % 1000) AS value
  FROM tx, (VALUES ('50', 3, 1), ('100', 6, 2), ('200', 8, 7), ('inf', 10, 10)) b(le, fast, late))""",
        """diffs AS (SELECT *, lag(value) OVER (PARTITION BY series, le ORDER BY ts_long, seq) AS before FROM cells)""",
        """steps0 AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END AS g FROM diffs)""",
        """moment AS (SELECT DISTINCT ts_long FROM cells)""",
        """gain AS (SELECT le, ts_long, sum(g) AS g FROM steps0 GROUP BY le, ts_long)""",
        """back AS (SELECT moment.ts_long, gain.le, sum(gain.g) AS value FROM moment JOIN gain ON gain.ts_long BETWEEN moment.ts_long - 3600 AND moment.ts_long GROUP BY ALL)""",
        """hist AS (SELECT c.ts_long, c.seq, b.le, b.value FROM (SELECT DISTINCT ts_long, seq FROM cells) c JOIN back b ON b.ts_long = c.ts_long)""",
        QUANTILE.format(q="0.95::DOUBLE", by="ts_long, seq"),
        f"""judged AS (SELECT ts_long, seq, {QUANTILE_VALUE} AS x FROM first)""",
        """marks AS (SELECT *, x > 180 AS over, coalesce(lag(x > 180) OVER (ORDER BY ts_long, seq), false) AS was FROM judged)""",
        """runs AS (SELECT *, last_value(CASE WHEN over AND NOT was THEN ts_long END IGNORE NULLS) OVER (ORDER BY ts_long, seq ROWS UNBOUNDED PRECEDING) AS since FROM marks)""",
        body="SELECT seq, round(x, 4) AS x, CASE WHEN NOT over THEN 'ok' WHEN ts_long - since >= 7200 THEN 'firing' ELSE 'pending' END AS state FROM runs",
    ),
)
def latency_alert_staggered(spark, sf):
    rule = alerts.Rule("HighLatencyP95", "request_latency_ms", "quantile", ">", 180, 7200, 3600, 0.95)
    return alerts.eval_alerts(staggered_samples(spark, sf), [rule]).select("seq", F.round("x", 4).alias("x"), "state")
