"""Transaction store and key-value table on files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskweave.operators.asof import asof_join

RETENTION_SECONDS = 15_552_000  # fixed value: 180 days
FEATURE_TTL, RISK_TTL = 3600, 600  # fixed values: seconds


def append_store(path: str, ts: str = "recorded_at"):
    """A ``foreachBatch`` writer: day-partitioned parquet, one folder per batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("day", F.to_date(ts))
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch_id}")

    return write


def write_table(df: DataFrame, name: str, path: str, key: str, buckets: int, ts: str = "recorded_at") -> DataFrame:
    """``df`` as a table of day folders, each bucketed by ``key`` and sorted by time: a look-up by key reads one bucket of each
    day, one file, and days beyond the retention are folders that can go whole."""
    dated = df.withColumn("day", F.to_date(ts))
    # rows meet by day and the bucket's number, so that each day and bucket is one file, and a key of very many rows is sorted
    # by as many tasks as there are days
    rows = dated.repartition("day", F.pmod(F.hash(key), F.lit(buckets)))
    rows.write.mode("overwrite").partitionBy("day").bucketBy(buckets, key).sortBy(ts).option("path", path).saveAsTable(name, format="parquet")
    return df.sparkSession.table(name)


def drop_days(spark: SparkSession, path: str, before: str) -> list[str]:
    """Remove the day folders of dates before ``before`` (``YYYY-MM-DD``); their dates.  No row is read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    days = [(status.getPath().getName(), status.getPath()) for status in files.listStatus(root)]
    gone = [(name[4:], folder) for name, folder in days if name.startswith("day=") and name[4:5].isdigit() and name[4:] < before]
    for _, folder in gone:
        files.delete(folder, True)
    return sorted(day for day, _ in gone)


def insert_unique(new: DataFrame, existing: DataFrame, key: str = "transaction_id", order: list[str] | None = None) -> DataFrame:
    """Rows whose key is neither stored nor repeated earlier in the batch.

    Repeats collapse by partial aggregation before the shuffle, so many copies of one id stay cheap.
    """
    first = F.min_by(F.struct(*new.columns), F.struct(*(order or new.columns))).alias("r")
    kept = new.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(first).select("r.*")
    return kept.join(existing.select(key), key, "left_anti").select(*new.columns)


def retain(df: DataFrame, as_of: Column, seconds: int = RETENTION_SECONDS, ts: str = "recorded_at") -> DataFrame:
    """Documents younger than ``seconds``; where the store is partitioned by ``day``, older days are never opened."""
    bound = as_of - F.make_dt_interval(secs=F.lit(seconds))
    if "day" in df.columns:
        df = df.where(F.col("day") >= F.to_date(bound))
    return df.where(F.col(ts) > bound)


def recent_by(df: DataFrame, key: str, value, n: int, ts: str = "recorded_at", tie: str = "transaction_id") -> DataFrame:
    return df.where(F.col(key) == value).orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def latest_per(df: DataFrame, key: str, n: int, ts: str = "recorded_at", tie: str = "transaction_id") -> DataFrame:
    """Newest ``n`` rows per key; Spark keeps ``n`` per key in each task before the shuffle."""
    spec = W.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("rank", F.row_number().over(spec)).where(F.col("rank") <= n)


def with_expiry(puts: DataFrame, ttl: Column | int, ts: str = "put_ts") -> DataFrame:
    seconds = F.lit(ttl) if isinstance(ttl, int) else ttl
    return puts.withColumn("expires_at", F.col(ts) + seconds)


def kv_latest(puts: DataFrame, tie: str = "seq") -> DataFrame:
    """Last write per key: one partial aggregate, no sort."""
    newest = F.max_by(F.struct("value", "put_ts", "expires_at"), F.struct("put_ts", tie))
    return puts.groupBy("key").agg(newest.alias("e")).select("key", "e.*")


def jitter_ttl(ttl: Column, pct: float = 0.1, seed: int = 0) -> Column:
    """Lengthen a TTL by up to ``pct``; never below one second."""
    return F.greatest(F.lit(1), ttl + F.floor(ttl * pct * F.rand(seed))).cast("bigint")


def kv_lookup(probes: DataFrame, puts: DataFrame, ts: str = "probe_ts", tie: str = "seq", **cut) -> DataFrame:
    """Value a reader sees at the probe's time: the newest write, if it has not expired by then."""
    found = asof_join(probes, puts, ["key"], ts, "put_ts", ["value", "put_ts", "expires_at"], tie, **cut)
    alive = F.col(ts) < F.col("expires_at")
    return found.withColumn("value", F.when(alive, F.col("value"))).drop("put_ts", "expires_at")
