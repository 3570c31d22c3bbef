"""Stacking, the macro F1 evaluator and the hold-out search."""

import numpy as np
import pytest
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from beaconflow.operators.evaluate import scores
from beaconflow.operators.splits import group_kfold
from beaconflow.plans.models import fit, make_pipeline, predict
from beaconflow.plans.search import GroupValidationSplit, MacroF1, holdout_search
from beaconflow.plans.stacking import fit_stack, out_of_fold, predict_stack, probability_columns

FEATURES, KINDS = ["a", "b"], ["tree", "logreg"]


@pytest.fixture(scope="module")
def frame(spark):
    x = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 23).alias("senderpseudo"),
                                ((F.col("id") * 7919) % 101 / 10.0).alias("a"), ((F.col("id") * 104729) % 53).cast("double").alias("b"))
    return group_kfold(x.withColumn("label", (F.col("a") > 5).cast("int") + (F.col("b") > 30).cast("int")), k=3).checkpoint()


def test_no_row_is_scored_by_a_model_that_saw_its_sender(frame):
    """Fold models are fitted again here, on the other folds only, and give the same probabilities."""
    oof = out_of_fold(frame, KINDS, "label", features=FEATURES, n_classes=3)
    assert oof.where("scored_by <> fold").count() == 0 and oof.count() == frame.count()
    assert oof.select("row_id").distinct().count() == frame.count()
    rows = {r.row_id: r for r in oof.collect()}
    for i in range(3):
        seen = {r.senderpseudo for r in frame.where(F.col("fold") != i).select("senderpseudo").distinct().collect()}
        for kind in KINDS:
            m, _ = fit(make_pipeline(kind, FEATURES, "label", None, None, 3), frame.where(F.col("fold") != i))
            for r in predict(m, frame.where(F.col("fold") == i), ["row_id", "senderpseudo"]).collect():
                assert r.senderpseudo not in seen
                assert np.allclose(r.probability, [rows[r.row_id][f"p_{kind}_{c}"] for c in range(3)], atol=1e-9)


def test_the_second_level_sees_probabilities_only(frame):
    stack = fit_stack(frame, KINDS, "label", features=FEATURES, n_classes=3)
    assert stack.meta.stages[0].getInputCols() == probability_columns(KINDS, 3)
    pred = predict_stack(stack, frame, ["row_id", "label"])
    assert pred.count() == 600 and scores(pred, "label", "prediction").first()["macro_f1"] > 0.95


def test_macro_f1_equals_scores_and_drives_a_cross_validator(frame):
    pipe = make_pipeline("tree", FEATURES, "label", None, {"max_depth": 1})
    pred = pipe.fit(frame).transform(frame)
    value = MacroF1("label").evaluate(pred)
    want = scores(pred.select("label", F.col("prediction").cast("int").alias("prediction")), "label", "prediction").first()["macro_f1"]
    assert value == pytest.approx(want, abs=1e-12) and MacroF1().isLargerBetter()
    grid = ParamGridBuilder().addGrid(pipe.getStages()[-1].getParam("maxDepth"), [1, 4]).build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=MacroF1("label"), foldCol="fold", numFolds=3).fit(frame)
    assert cv.avgMetrics[1] > cv.avgMetrics[0]


def test_holdout_search_uses_the_given_sides(frame):
    data = frame.withColumn("validation", F.when(F.col("fold") < 2, F.col("fold") == 1))  # fold 2: neither
    found = holdout_search(data.where("fold < 2"), "label", FEATURES, {"maxDepth": [1, 5]}, "tree")
    for depth, metric in zip((1, 5), found.validationMetrics):
        m, _ = fit(make_pipeline("tree", FEATURES, "label", None, {"max_depth": depth}), data.where("not validation"))
        assert metric == pytest.approx(MacroF1("label").evaluate(m.transform(data.where("validation"))), abs=1e-12)
    assert found.bestModel.stages[-1].getOrDefault("maxDepth") == 5 and GroupValidationSplit().split_col == "validation"
