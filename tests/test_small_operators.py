"""Direct checks of the small operators (contracts, projections, unions, report helpers)."""

import pytest
from pyspark.sql import functions as F

from beaconflow.operators import evaluate as E
from beaconflow.operators import labels as L
from beaconflow.operators import profile as P
from beaconflow.schema import MESSAGE_29
from beaconflow.sources.messages import check_contract, load_messages, lower_columns, select_features
from conftest import SF_SMALL


def test_contract_projection_and_lower_case(spark):
    m = load_messages(spark, SF_SMALL)
    check_contract(m.select(*reversed(MESSAGE_29)))  # any order is fine
    with pytest.raises(ValueError):
        check_contract(m.select(*MESSAGE_29[:-1]))
    with pytest.raises(ValueError, match="posq"):
        select_features(m, ["posx", "posq"])
    assert lower_columns(m.select(F.col("posx").alias("PosX"))).columns == ["posx"]


def test_fill_union_and_sender_filters(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 3, None)], "k long, a int, b double")
    filled = {r["k"]: r for r in L.fill_zero(df).collect()}
    assert filled[1]["a"] == 0 and filled[2]["b"] == 0.0
    u = L.union_splits(df.where("k = 1"), df.where("k = 2").select("b", "a", "k"))
    assert sorted(r["k"] for r in u.collect()) == [1, 2]
    m = load_messages(spark, SF_SMALL).select("row_id", "senderpseudo")
    some = L.distinct_senders(m).limit(3)
    kept = L.keep_senders(m, some).count()
    dropped = L.keep_senders(m, some, keep=False).count()
    assert kept + dropped == m.count() and kept > 0


def test_profile_info_and_head(spark):
    m = load_messages(spark, SF_SMALL)
    info = {r["feature"]: r for r in P.profile_info(m.select("row_id", "posx", "type")).collect()}
    assert info["posx"]["dtype"] == "double" and info["type"]["dtype"] == "int"
    assert info["row_id"]["non_null"] == m.count()
    head = [r["row_id"] for r in P.profile_head(m, 3).collect()]
    assert head == sorted(r["row_id"] for r in m.orderBy("row_id").limit(3).collect())


def test_confusion_wide_delta_and_fold_summary(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, prediction int")
    wide = {r["label"]: r for r in E.confusion_wide(pairs, classes=[0, 1]).collect()}
    assert wide[0]["0"] == 1 and wide[0]["1"] == 1 and wide[1]["1"] == 2 and wide[1]["0"] == 0
    cur = spark.createDataFrame([("accuracy", 0.9), ("macro_f1", 0.7)], "metric string, value double")
    base = spark.createDataFrame([("accuracy", 0.87), ("macro_f1", 0.76)], "metric string, value double")
    d = {r["metric"]: r for r in E.baseline_delta(cur, base).collect()}
    assert d["accuracy"]["verdict"] == "improved" and d["macro_f1"]["verdict"] == "worse"
    assert abs(d["accuracy"]["delta_pct"] - 0.03 / 0.87 * 100) < 1e-9
    folds = spark.createDataFrame([(0, "accuracy", 0.8), (1, "accuracy", 0.9)], "fold int, metric string, value double")
    s = E.fold_summary(folds, ["metric"]).first()
    assert s["n_folds"] == 2 and abs(s["mean"] - 0.85) < 1e-12 and abs(s["two_std"] - 0.1) < 1e-12


def test_alternate_paths_agree(spark):
    from beaconflow.operators import scaling as Z
    m = load_messages(spark, SF_SMALL)
    w = Z.class_weights(m, "class")
    by_class = {r["class"]: r["weight"] for r in w.collect()}
    got = Z.with_weight(m.withColumn("weight_of", F.lit(1)), w, "class").select("class", "weight").collect()
    assert len(got) == m.count() and all(r["weight"] == by_class[r["class"]] for r in got)
    none = Z.with_weight(m.select("row_id", F.lit(None).cast("int").alias("class")), w, "class")
    assert none.count() == m.count() and none.where("weight is not null").count() == 0
    exact = {r["feature"]: r["n_distinct"] for r in P.distinct_counts(m, ["posx", "posy"]).collect()}
    approx = {r["feature"]: r["n_distinct"] for r in P.distinct_counts(m, ["posx", "posy"], approx=True).collect()}
    assert all(abs(approx[c] - exact[c]) <= 0.1 * exact[c] + 2 for c in exact)
