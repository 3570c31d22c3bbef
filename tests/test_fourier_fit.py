"""The machines on random Fourier features are fitted without the mapped rows being stored."""

import numpy as np
from pyspark.sql import functions as F

from beaconflow.plans.fourier import Descent, FourierSVCModel
from beaconflow.plans.models import fit, make_pipeline, predict


def test_descent_finds_the_least_value():
    a, d = np.diag([1.0, 10.0, 100.0]), Descent(3, 100, tol=1e-12)
    while d.left > 0:
        d.told(float((d.at - 1) @ a @ (d.at - 1)), 2 * a @ (d.at - 1))
    assert np.abs(d.x - 1).max() < 1e-4


def test_mapped_rows_are_not_stored(spark):
    df = spark.range(600).select(F.cos(F.col("id") * 1.0).alias("a"), F.sin(F.col("id") * 1.0).alias("b"), (F.col("id") % 3).alias("label"),
                                 F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0).alias("w"))
    df = df.withColumns({c: F.col(c) * (F.col("label") + 1) for c in "ab"}).repartition(2).checkpoint()
    model, _ = fit(make_pipeline("svc_rbf", ["a", "b"], "label", None, {"rbf_gamma": 2.0, "max_iter": 20}, 3), df)
    assert isinstance(model.stages[-1], FourierSVCModel)
    right = predict(model, df, ["label"]).select(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert right > 0.97
    # rows of weight 0 count for nothing
    weighted, _ = fit(make_pipeline("svc_rbf", ["a", "b"], "label", "w", {"rbf_gamma": 2.0, "max_iter": 5}, 3),
                      df.withColumn("label", F.when(F.col("w") > 0, F.col("label")).otherwise(0)))
    assert predict(weighted, df.where("w > 0"), ["label"]).where(F.col("label") == F.col("prediction")).count() > 290
