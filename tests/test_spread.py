"""Joins with a table of classes leave the rows where they are, and fits get even partitions."""

import pytest
from pyspark.sql import functions as F

from beaconflow.operators.scaling import class_weights, with_weight
from beaconflow.operators.splits import stratified_sample, stratified_split
from beaconflow.plans import models as M


@pytest.fixture
def one_class(spark):
    """4 partitions of one class, where Spark broadcasts only what it is told to."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.range(400).select(F.col("id").alias("row_id"), F.lit(1).alias("class")).repartition(4).checkpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_a_class_is_not_gathered_in_one_task(one_class):
    assert sizes(with_weight(one_class, class_weights(one_class))) == [100] * 4
    split = stratified_split(one_class)
    assert sizes(split) == [100] * 4 and {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"test": 80, "val": 64, "train": 256}
    taken = stratified_sample(one_class, rate=0.5)
    assert taken.count() == 200 and len(sizes(taken)) == 4


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_TASK", 50)
    df = spark.range(1000).coalesce(1)
    for even in (M.spread(df), M.spread(df, 1000)):
        assert len(sizes(even)) == 20 and max(sizes(even)) < 75 and even.distinct().count() == 1000
    assert M.spread(df.limit(0)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
