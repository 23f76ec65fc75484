"""Tables in the shared folder: what a write shuffled is freed, and only paths below the root can be deleted."""

import pytest
from pyspark.sql import functions as F

from stateweave.session import discard, shared_path, shared_root, written


def test_written_table_is_whole_and_setting_restored(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    path = shared_path(spark, "session-test")
    table = written(df, path)
    assert sorted(table.collect()) == sorted(df.collect())
    assert spark.conf.get(key) == before
    discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_only_below_the_shared_root(spark):
    for path in ("/tmp", shared_root(spark), shared_root(spark) + "-other/x"):
        with pytest.raises(ValueError):
            discard(spark, path)
