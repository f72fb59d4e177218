import time

from pyspark.sql import functions as F

from sedgeline import scratch


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def test_shuffle_files_go_with_the_table_that_they_were_for(spark):
    setting = spark.conf.get(scratch.CLEANUP, None)
    before = shuffle_files(spark)
    rows = spark.range(20_000).withColumn("x", F.rand(5))
    out = scratch.table(rows.repartition("x").groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")), "counted")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert sum(r.n for r in out.collect()) == 20_000 and spark.conf.get(scratch.CLEANUP, None) == setting
