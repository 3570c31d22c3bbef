"""Stored sketches: the merge of the parts equals the sketch of the whole within the stated errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconflow.operators import sketches as K


def test_merge_of_parts(spark, tmp_path):
    df = spark.range(40_000).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(9_000)).cast("double").alias("a"), (F.lit(1e9) + F.rand(3)).alias("b"),
        F.when(F.col("id") % 3 == 0, float("nan")).when(F.col("id") % 3 == 1, F.col("id") % 7).cast("double").alias("c"),
        F.lit(None).cast("double").alias("d"))
    df = df.checkpoint()
    cols = ["a", "b", "c", "d"]
    path = str(tmp_path / "sketches")
    for lo, hi in ((0, 100), (100, 25_000), (25_000, 40_000)):
        K.sketch_rows(df.where((F.col("id") >= lo) & (F.col("id") < hi)).withColumn("part", F.lit(lo)), cols, "part").write.mode("append").parquet(path)
    got = {r.feature: r for r in K.merged_profile(spark.read.parquet(path)).collect()}
    x = df.toPandas()
    for c in ("a", "b", "c"):
        v, r = x[c].dropna().to_numpy(), got[c]
        assert (r.n_rows, r["count"], r["min"], r["max"]) == (40_000, len(v), v.min(), v.max())
        assert r["mean"] == pytest.approx(v.mean(), rel=1e-12) and r["std"] == pytest.approx(v.std(ddof=1), rel=1e-6)
        distinct = len(np.unique(v))
        assert abs(r.n_distinct - distinct) <= max(2, K.DISTINCT_ERROR * distinct)
        for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            assert (v < r[n]).mean() <= p + K.RANK_ERROR and (v <= r[n]).mean() >= p - K.RANK_ERROR
    assert got["d"]["count"] == 0 and got["d"].n_distinct == 0 and got["d"]["mean"] is None and got["d"].q50 is None


def test_the_stored_rows_are_few(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("part"), F.col("id").cast("double").alias("a"))
    assert K.sketch_rows(df, ["a"], "part").count() == 4
    assert K.merged_profile(K.sketch_rows(df.limit(0), ["a"], "part")).collect() == []
