"""Labels, scaling and binary-classifier evaluation; every full pass aggregates before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskweave.operators.ranks import quantile, running_totals

# Threshold grid 0.10, 0.11, ... 0.90.
GRID_START, GRID_STEP, GRID_SIZE = 0.1, 0.01, 81


def grid_value(i: Column) -> Column:
    return F.lit(GRID_START) + i * F.lit(GRID_STEP)


def label_by_quantile(df: DataFrame, col: str, q: float, cond: Column | None = None, out: str = "label") -> DataFrame:
    """1 where ``col`` exceeds its exact quantile and ``cond`` holds; a null or NaN is 0."""
    bound = quantile(df, col, q)  # one row
    hit = (F.col(col) > F.col("q")) & ~F.isnan(F.col(col).cast("double"))  # NaN is greater than any number in Spark
    if cond is not None:
        hit = hit & cond
    return df.crossJoin(F.broadcast(bound)).withColumn(out, F.coalesce(hit.cast("int"), F.lit(0))).drop("q")


def label_by_rule(df: DataFrame, out: str = "label") -> DataFrame:
    rule = (F.col("amount") > 1500) & (F.col("hour_of_day") < 6) & (F.col("location_risk_score") > 0.7)
    return df.withColumn(out, rule.cast("int"))


def class_report(df: DataFrame, y: str, pred: str, beta: float = 1.0) -> DataFrame:
    """Precision, recall, F-beta and support for class 0 and class 1; 0 where undefined."""
    cells = df.groupBy(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("class")
    counts = cells.select("*", sides).groupBy("class").agg(
        F.sum(F.when((F.col("y") == F.col("class")) & (F.col("p") == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("p") == F.col("class"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("y") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
    )
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    b = beta * beta
    score = F.coalesce(F.try_divide((1 + b) * F.col("precision") * F.col("recall"), F.col("precision") * b + F.col("recall")), F.lit(0.0))
    return (
        counts.withColumns({"precision": precision, "recall": recall})
        .withColumn("f_beta", score)
        .select("class", "precision", "recall", "f_beta", "support")
    )


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row ``auc``; tied scores count half, null when a class is empty."""
    totals = {"_pos": F.sum(F.when(F.col(y) == 1, 1).otherwise(0)), "_neg": F.sum(F.when(F.col(y) == 1, 0).otherwise(1))}
    ranked = running_totals(df.select(y, p), p, totals)
    won = F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / 2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.agg(F.try_divide(won, pairs).alias("auc"))


def sweep(df: DataFrame, y: str, p: str) -> DataFrame:
    """Confusion counts at every grid threshold (``p >= t``).

    Scores collapse to the index of the highest threshold they reach, at most 82 rows, before the grid is met;
    the data are read once and never multiplied by the grid.
    """
    score = F.col(p).cast("double")
    guess = F.least(F.lit(GRID_SIZE - 1), F.greatest(F.lit(-1), F.floor((score - GRID_START) / GRID_STEP)))
    reach = guess + 1
    level = (
        F.when((reach < GRID_SIZE) & (score >= grid_value(reach)), reach)
        .when((guess >= 0) & (score >= grid_value(guess)), guess)
        .otherwise(F.greatest(guess - 1, F.lit(-1)))
    )
    counted = (
        df.where(score.isNotNull() & ~F.isnan(score))
        .groupBy(level.cast("int").alias("i"))
        .agg(
            F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"),
        )
    )
    grid = df.sparkSession.range(-1, GRID_SIZE).select(F.col("id").cast("int").alias("i"))
    above = W.orderBy(F.col("i").desc()).rowsBetween(W.unboundedPreceding, 0)
    zero = F.lit(0).cast("bigint")
    reached = grid.join(counted, "i", "left").select(
        "i",
        F.sum(F.coalesce("pos", zero)).over(above).alias("tp"),
        F.sum(F.coalesce("neg", zero)).over(above).alias("fp"),
        F.sum(F.coalesce("pos", zero)).over(W.partitionBy()).alias("positives"),
    )
    return reached.where("i >= 0").select(
        "i", grid_value(F.col("i")).alias("threshold"), "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn")
    )


def optimal_threshold(df: DataFrame, y: str, p: str) -> DataFrame:
    """Grid threshold with the best ``F1/2 + P/4 + R/4``; the lowest one wins ties."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0))
    graded = sweep(df, y, p).withColumn("score", f1 * 0.5 + precision * 0.25 + recall * 0.25)
    return graded.orderBy(F.col("score").desc(), "threshold").limit(1).select("threshold", "score")


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with ``<col>_mean`` and ``<col>_std`` (population; 1 where the column is constant)."""
    std = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return df.agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}_mean"), std(c).alias(f"{c}_std"))])


def scale(df: DataFrame, scaler: DataFrame, cols: list[str]) -> DataFrame:
    """Replace ``cols`` by their standard scores; ``scaler`` is the single row of :func:`fit_scaler`."""
    joined = df.crossJoin(F.broadcast(scaler))
    scaled = joined.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in cols})
    return scaled.drop(*scaler.columns)
