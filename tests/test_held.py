import time

from pyspark.sql import functions as F

from querysieve.operators.held import held

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_shuffle_files_go_once_a_frame_is_held(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEAN_UP)
    counts = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    first = held(counts)
    second = held(counts.join(first.withColumnRenamed("count", "again"), "k").groupBy("again").agg(F.sum("count").alias("n")))
    for _ in range(100):  # they are deleted behind our back
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(CLEAN_UP) == setting
    # What has been held can be read again, and so can the frame that it was made from.
    assert [tuple(r) for r in second.collect()] == [(100, 10_000)]
    assert counts.count() == first.count() == held(counts).count() == 100
