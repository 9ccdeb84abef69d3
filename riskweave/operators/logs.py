"""JSON logs: parsing, filtering, correlation, and the audit of content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.schema import LOG_FIELDS

# Fields promoted from a log line, and those that become labels.
PROMOTED = ["message", "correlation_id", "route", "service", "level", "decision", "score", "model_version"]
LABELS = ["correlation_id", "service", "route"]


def parse_log(df: DataFrame, col: str) -> DataFrame:
    """Promoted fields as columns, labels as a map, everything else of the line kept as a map."""
    whole = F.from_json(col, "map<string,string>")
    known = [f.name for f in LOG_FIELDS]
    rest = F.map_filter(whole, lambda k, v: ~k.isin(known))
    parsed = df.withColumn("_log", F.from_json(col, LOG_FIELDS)).withColumn("rest", rest)
    labels = F.map_filter(
        F.create_map(*[x for name in LABELS for x in (F.lit(name), F.col(f"_log.{name}"))]), lambda k, v: v.isNotNull()
    )
    return parsed.withColumn("labels", labels).withColumns({n: F.col(f"_log.{n}") for n in PROMOTED}).drop("_log")


def log_contains(df: DataFrame, col: str, text: str) -> DataFrame:
    return df.where(F.col(col).contains(text))


def query_logs(df: DataFrame, labels: dict[str, str], start: Column, end: Column, n: int = 50, order: str = "ts") -> DataFrame:
    """Newest ``n`` lines with the given labels inside ``[start, end)``; ``event_id`` orders equal times."""
    cond = (F.col(order) >= start) & (F.col(order) < end)
    for name, value in labels.items():
        cond = cond & (F.col(name) == value)
    return df.where(cond).orderBy(F.col(order).desc(), F.col("event_id").desc()).limit(n)


def correlate(a: DataFrame, b: DataFrame, on: str = "correlation_id") -> DataFrame:
    """Correlation ids seen by both sides with the number of lines of each.

    Both sides are counted per id first, so a busy id meets as one row instead of all pairs of its lines.
    """
    left = a.groupBy(on).agg(F.count(F.lit(1)).alias("left_lines"), F.min("ts_long").alias("first_ts"))
    right = b.groupBy(on).agg(F.count(F.lit(1)).alias("right_lines"), F.max("ts_long").alias("last_ts"))
    return left.join(right, on)


def audit_hashes(manifest: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Manifest entries whose content is missing or differs: ``key, reason``."""
    both = manifest.select(key, F.col("hash").alias("_want")).join(actual.select(key, F.col("hash").alias("_have")), key, "left")
    reason = F.when(F.col("_have").isNull(), "missing").when(F.col("_have") != F.col("_want"), "mismatch")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def file_hashes(spark, path: str) -> DataFrame:
    """SHA-256 per file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("hash"))
