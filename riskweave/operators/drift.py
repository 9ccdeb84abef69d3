"""Feature drift: baseline tables, binning, population stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6  # fixed value: floor of a proportion
WARN, CRIT = 0.2, 0.3  # fixed values: severity bounds

BASELINE_JSON = "map<string, struct<edges: array<double>, expected: array<double>>>"


def parse_baseline(df: DataFrame, col: str, keep: list[str] | None = None) -> DataFrame:
    """JSON objects ``{feature: {edges, expected}}`` as rows ``feature, bin, lo, hi, expected``; malformed features go."""
    entries = df.select(*(keep or []), F.explode(F.from_json(col, BASELINE_JSON)).alias("feature", "meta"))
    fits = F.size("meta.expected") == F.greatest(F.size("meta.edges") - 1, F.lit(0))
    valid = entries.where("meta.edges is not null and meta.expected is not null").where(fits)
    bins = valid.select(*(keep or []), "feature", "meta.edges", F.posexplode("meta.expected").alias("bin", "expected"))
    edge = lambda shift: F.get("edges", F.col("bin") + shift)
    return bins.select(*(keep or []), "feature", "bin", edge(0).alias("lo"), edge(1).alias("hi"), "expected")


def load_baseline(spark, path: str, field: str = "drift_baseline") -> DataFrame:
    """Read a metadata file; its ``field`` holds the baseline object."""
    text = spark.read.text(path, wholetext=True)
    return parse_baseline(text.select(F.get_json_object("value", f"$.{field}").alias("baseline")), "baseline")


def bin_index(value: Column, edges: list[float]) -> Column:
    """0-based bin: half-open bins, the last one open above; null below the first edge, for null and for NaN."""
    number = value.cast("double")
    index = F.when(number >= edges[-2], len(edges) - 2)
    for i in range(len(edges) - 3, -1, -1):
        index = index.when((number >= edges[i]) & (number < edges[i + 1]), i)
    return F.when(~F.isnan(number), index)


def baseline_edges(base: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """Edges per feature on the driver: one row per bin of the frame's own feature columns, a configuration's size."""
    edges: dict[str, list[float]] = {}
    for row in base.where(F.col("feature").isin(features)).orderBy("feature", "bin").collect():
        edges.setdefault(row["feature"], [row["lo"]]).append(row["hi"])
    return edges


def bin_counts(df: DataFrame, base: DataFrame) -> DataFrame:
    """Rows per feature and bin, one scan and one small shuffle (partial counts) for all features."""
    edges = baseline_edges(base, df.columns)
    cells = [F.struct(F.lit(name).alias("feature"), bin_index(F.col(name), e).alias("bin")) for name, e in edges.items()]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return long.where("bin is not null").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def join_bins(obs: DataFrame, base: DataFrame) -> DataFrame:
    """Every baseline bin with its observed count, 0 where nothing fell into it."""
    return base.join(obs, ["feature", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def severity(psi: Column) -> Column:
    return F.when(psi >= CRIT, "crit").when(psi >= WARN, "warn").otherwise("ok")


def psi_from_bins(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """PSI per feature from rows ``feature, bin, expected, n``."""
    by = [*(by or []), "feature"]
    totals = bins.groupBy(*by).agg(F.sum("n").alias("total"))
    share = F.col("n") / F.greatest(F.col("total"), F.lit(1))
    o, e = F.greatest(share, F.lit(EPS)), F.greatest(F.col("expected"), F.lit(EPS))
    return (
        bins.join(totals, by)
        .groupBy(*by)
        .agg(F.sum((o - e) * F.log(o / e)).alias("psi"))
        .withColumn("severity", severity(F.col("psi")))
    )


def psi(df: DataFrame, base: DataFrame) -> DataFrame:
    return psi_from_bins(join_bins(bin_counts(df, base), base))
