"""The derived lines are dealt out by number, however the table's rows lie in files and row groups."""

from pyspark.sql import functions as F

from logloom.plans import raw_logs


def test_one_row_group_in_many_splits(spark, tmp_path, monkeypatch):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(raw_logs, "TASK_LINES", 50, raising=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.parquet(f"{tmp_path}/events.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        of_task = raw_logs.raw_logs(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(r["count"] for r in of_task) == 1000 and max(r["count"] for r in of_task) <= 60
