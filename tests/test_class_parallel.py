"""One-vs-rest models fit several classes side by side, with the models that one after another gives."""

import pytest

from beaconflow.plans.models import make_pipeline


@pytest.mark.parametrize("kind, params", [("svc_ovr", {"max_iter": 5}), ("boosted", {"n_estimators": 2, "max_depth": 2})])
def test_classes_side_by_side_give_the_same_model(spark, kind, params):
    df = spark.createDataFrame([(float(k % 7), float(k % 5), k % 3) for k in range(120)], "a double, b double, label int").repartition(2).cache()
    pipe = make_pipeline(kind, ["a", "b"], params=params, n_classes=3)
    ovr = pipe.getStages()[-1]
    assert ovr.getParallelism() > 1
    side = [r.prediction for r in pipe.fit(df).transform(df).orderBy("a", "b", "label").collect()]
    ovr.setParallelism(1)
    assert side == [r.prediction for r in pipe.fit(df).transform(df).orderBy("a", "b", "label").collect()]
    df.unpersist()
