"""Tree models as node tables: the export scores as the pipeline does, by joins and row by row."""

import pytest
from pyspark.sql import functions as F

from beaconflow.plans import node_table as N
from beaconflow.plans.models import fit, make_pipeline, predict

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    x = spark.range(600).select("id", ((F.col("id") * 7919) % 101 / 10.0).alias("a"), ((F.col("id") * 104729) % 53).cast("double").alias("b"),
                                F.when(F.col("id") % 11 != 0, F.col("id") % 5).cast("double").alias("c"), F.lit(1.0).alias("flat"))
    label = (F.col("a") > 5).cast("int") + (F.col("b") > 30).cast("int") + F.when(F.col("c") == 2, 1).otherwise(0)
    return x.withColumn("label", label).fillna(0.0, ["c"]).checkpoint()


def scored(df):
    return sorted((r.id, r.prediction, tuple(round(p, 12) for p in r.probability)) for r in df.collect())


@pytest.mark.parametrize("kind,params", [("forest", {"n_estimators": 5, "max_depth": 4}), ("tree", {"max_depth": 6})])
def test_export_scores_as_the_pipeline(frame, kind, params, monkeypatch):
    model, _ = fit(make_pipeline(kind, FEATURES + ["flat"], "label", None, params, 4), frame)
    table = N.export_nodes(model)
    want = scored(predict(model, frame, ["id"]))
    assert scored(predict(table, frame, ["id"])) == want and scored(N.score_rows(table, frame, ["id"])) == want
    monkeypatch.setattr(N, "BROADCAST_NODES", 0)  # a table too large to broadcast
    assert scored(N.score_nodes(table, frame, ["id"])) == want
    with pytest.raises(ValueError):
        N.score_rows(table, frame, ["id"])


def small(spark, link="share"):
    rows = [(0, 0, 0, 1.5, 1, 2, None), (0, 1, None, None, None, None, [1.0, 0.0]), (0, 2, None, None, None, None, [0.25, 0.75]),
            (1, 0, None, None, None, None, [0.5, 0.5])]
    return N.node_table(spark, rows, ["x"], 2, link)


def test_missing_values_repeated_rows_and_keys(spark):
    """NULL and NaN go right; equal rows come back as often as they came; equal and null keys stay apart."""
    data = [(1, 1.0), (1, 1.0), (1, 2.0), (2, None), (None, float("nan")), (None, 1.5), (None, 1.5)]
    df = spark.createDataFrame(data, "k int, x double").repartition(3)
    low, high = (0, (0.75, 0.25)), (1, (0.375, 0.625))
    want = sorted([(1, *low), (1, *low), (1, *high), (2, *high), (None, *high), (None, *low), (None, *low)], key=repr)
    for score in (N.score_nodes, N.score_rows):
        got = [(r.k, r.prediction, tuple(r.probability)) for r in score(small(spark), df, ["k"]).collect()]
        assert sorted(got, key=repr) == want
    assert N.score_nodes(small(spark), df.limit(0), ["k"]).collect() == []


def test_margins_and_saved_tables(spark, tmp_path):
    import math
    N.save_nodes(small(spark, "softmax"), str(tmp_path / "nodes"))
    model = N.load_nodes(spark, str(tmp_path / "nodes"))
    assert (model.features, model.n_classes, model.link, model.size()) == (["x"], 2, "softmax", (2, 1, 4))
    p = N.score_nodes(model, spark.createDataFrame([(1, 0.0)], "k int, x double"), ["k"]).first().probability
    assert p[0] == pytest.approx(math.exp(1.5) / (math.exp(1.5) + math.exp(0.5)))
