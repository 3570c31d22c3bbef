"""Random Fourier features approach the RBF kernel, and a linear machine on them separates what no line does."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from beaconflow.operators.evaluate import scores
from beaconflow.plans.fourier import RandomFourier
from beaconflow.plans.models import fit, make_pipeline, predict, soft_vote_models


def test_kernel_error_is_bounded(spark):
    x = np.random.default_rng(1).normal(size=(200, 5))
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["id", "features"]).repartition(3)
    kernel = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    error = []
    for dims in (256, 4096):
        z = RandomFourier(dims=dims, gamma=0.3).transform(df).orderBy("id").select(vector_to_array("fourier").alias("z")).collect()
        z = np.array([r.z for r in z])
        error.append(np.abs(z @ z.T - kernel).max())
    assert error[0] < 0.35 and error[1] < 0.1 and error[1] < error[0]


def test_missing_components_and_empty_frames(spark):
    df = spark.createDataFrame([(Vectors.dense([float("nan"), 1.0]),), (Vectors.dense([0.0, 1.0]),)], ["features"])
    a, b = [r.fourier for r in RandomFourier(dims=8).transform(df).collect()]
    assert a == b and RandomFourier().transform(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def rings(spark):
    r = np.random.default_rng(2)
    angle, radius = r.uniform(0, 6.28, 900), np.repeat([1.0, 2.0, 3.0], 300) + r.normal(scale=0.1, size=900)
    rows = [(i, float(q * np.cos(a)), float(q * np.sin(a)), i // 300) for i, (a, q) in enumerate(zip(angle, radius))]
    return spark.createDataFrame(rows, "id int, a double, b double, label int").repartition(2).checkpoint()


def test_rings_need_the_kernel(rings, tmp_path):
    f1 = {}
    for kind, params in (("svc_ovr", {}), ("svc_rbf", {"rbf_gamma": 2.0})):
        model, _ = fit(make_pipeline(kind, ["a", "b"], "label", None, params, 3), rings)
        f1[kind] = scores(predict(model, rings, ["label"]), "label", "prediction").first()["macro_f1"]
    assert f1["svc_rbf"] > 0.97 > 0.7 > f1["svc_ovr"]
    model.write().overwrite().save(str(tmp_path / "m"))
    again = predict(PipelineModel.load(str(tmp_path / "m")), rings, ["id"])
    assert again.exceptAll(predict(model, rings, ["id"])).count() == 0
    vote = soft_vote_models([model, model], rings, ["id"])
    assert vote.join(predict(model, rings, ["id"]).withColumnRenamed("prediction", "p"), "id").where(F.col("p") != F.col("prediction")).count() == 0
