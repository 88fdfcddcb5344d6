"""Work tables."""
from pyspark.sql import functions as F

from eventscope.llm.common import CLEANUP, saved


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(k).getName() for k in range(files.size())) if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    rows = spark.createDataFrame([(k % 7, k) for k in range(100)], "k long, v long").repartition(5)
    sums = rows.groupBy("k").agg(F.sum("v").alias("s"))
    both = rows.join(sums.hint("merge"), "k")
    had, before = shuffle_files(spark), spark.conf.get(CLEANUP, "false")
    one = saved(both, "test-work-table")
    assert shuffle_files(spark) <= had
    assert spark.conf.get(CLEANUP, "false") == before
    two = saved(both, "test-work-table")    # the same frame again, and then as it is
    want = sorted((k % 7, k, sum(range(k % 7, 100, 7))) for k in range(100))
    for got in (one, two, both):
        assert sorted(tuple(r) for r in got.collect()) == want
