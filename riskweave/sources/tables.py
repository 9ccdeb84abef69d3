"""Columnar loaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; zone-less timestamps become instants (UTC is pinned in the session)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def load_training(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Training rows; only ``columns`` are read from the files."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
