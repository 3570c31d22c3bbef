"""Flagship query: per-class means of the engineered sequence features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators.features import engineer_features
from ..schema import ENGINEERED_17
from ..sources.messages import load_messages


def class_feature_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load_messages(spark, sf_dir)
    f = engineer_features(m, keep=["row_id", "senderpseudo", "class"])
    aggs = [r6(F.avg(c)).alias(f"avg_{c}") for c in ENGINEERED_17]
    return f.groupBy("class").agg(F.count(F.lit(1)).alias("n_messages"), *aggs)
