"""Session settings, the shared checkpoint folder, and shipping of Python helpers to workers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import riskweave

# Runtime SQL settings every job here relies on.  UTC is needed for right results; AQE coalesces
# and skew-splits shuffles, so no fixed partition count is set.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLAIN_FILES = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else may have built."""
    for name, value in RUNTIME_CONF.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    # Workers need no copy of this package on their path: its functions travel by value.
    cloudpickle.register_pickle_by_value(riskweave)
    return spark


TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def small_tasks(spark: SparkSession) -> SparkSession:
    """Let a task read about 16 MB of shuffled data.  Rows of keyed tables shrink to a few bytes in a shuffle, and a task that
    sorts several frames of Spark's usual 64 MB holds gigabytes."""
    spark.conf.set(TASK_BYTES, "16m")
    return spark


def build(app: str = "riskweave", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; the cluster's own settings win where ``master`` and ``conf`` are left out."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(name, value)
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a single-machine session (master ``local[...]``, as in tests) gets a temporary folder; on a
    cluster executors would each write to their own disk, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="riskweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes started inside remove their shuffle files once the table is there, as nothing reads them again.  Otherwise these
    stay on the executors' disks until the driver collects garbage."""
    usual = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, usual)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back.

    Lost executors then cost no recomputation, several readers share one computation, and unlike a checkpointed
    RDD the table keeps column pruning and size statistics.  Tables of one application share a folder, which may be
    dropped when the application is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riskweave-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``cut`` as a table bucketed by ``key``: what groups or joins by it later reads the rows without a shuffle."""
    spark = df.sparkSession
    name = f"riskweave_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/riskweave-tables/{spark.sparkContext.applicationId}/{name}"
    with shuffles_dropped(spark):
        df.write.bucketBy(min(buckets, 100_000), key).option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)
