"""Candidates of a cross-validated parameter search share each fold's scaled rows, and score as if fitted one by one."""

import numpy as np
import pytest
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from beaconflow.operators.evaluate import scores
from beaconflow.plans import models, search

FEATURES = ["a", "b", "c"]


def test_folds_are_scaled_once_for_all_candidates(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), i % 3, float(1 + i % 2), *map(float, rng.normal(k, 2, 3))) for i, k in enumerate(rng.integers(0, 3, 400))]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "label int, fold int, w double, a double, b double, c double").checkpoint()
    fitted, fit = [], StandardScaler._fit
    monkeypatch.setattr(StandardScaler, "_fit", lambda self, d: (fitted.append(1), fit(self, d))[1])
    bounds = [(2, 4), (0.01, 0.3), (2, 6), (0.6, 1.0), (0.6, 1.0), (0, 5), (1, 10), (0, 10), (0, 10)]
    r = search.param_search(df, "label", FEATURES, bounds, [3, 0.07, 4, 0.9, 0.9, 0, 1, 0, 1], generations=1, population=4,
                            objective="group_cv", kind="forest", weight="w", parallelism=2)
    assert len(fitted) == 3  # one for each fold, not for each of eight candidates and three folds
    runs = r["runs"].orderBy("run").collect()
    assert [x.run for x in runs] == list(range(8))
    data = models.spread(df).persist()
    data.count()
    for x in (runs[0], runs[5]):
        p = {k: v for k, v in search.decode_params([x[n] for n in search.PARAM_NAMES]).items() if k in models.PARAMS_OF["forest"]} | {"seed": 42}
        f1 = []
        for k in range(3):
            m, _ = models.fit_kind("forest", data.where(F.col("fold") != k), FEATURES, "label", "w", p, persist=False)
            f1.append(scores(models.predict(m, data.where(F.col("fold") == k), ["label"]), "label", "prediction").first()["macro_f1"])
        assert x.macro_f1 == pytest.approx(np.mean(f1))
