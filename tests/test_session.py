"""Session settings of the registered queries."""

import time

from riskweave import session
from riskweave.plans import QUERIES
from riskweave.session import TASK_BYTES


def test_queries_read_small_shuffle_partitions(spark):
    spark.conf.unset(TASK_BYTES)
    QUERIES["m5_decide"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(TASK_BYTES) == "16m"


def test_a_cut_leaves_no_shuffle_files(spark):
    """The shuffle of a written table goes with the write; without that, files stay until the driver collects garbage."""
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}

    before, usual = shuffles(), spark.conf.get(session.SHUFFLES_GO)
    table = session.cut(spark.range(20_000).repartition(4, "id"))
    for _ in range(50):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 20_000 and spark.conf.get(session.SHUFFLES_GO) == usual
