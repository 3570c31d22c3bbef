import pytest
from pyspark.sql import functions as F

from beaconflow.operators.features import engineer_features
from beaconflow.operators.splits import group_holdout
from beaconflow.plans import models as M
from beaconflow.plans import search as H
from beaconflow.schema import ENGINEERED_17, MESSAGE_29
from beaconflow.sources.messages import load_messages
from conftest import SF_MID, SF_SMALL, rows

SMALL_FOREST = {"n_estimators": 10, "max_depth": 5, "seed": 42}


@pytest.fixture(scope="module")
def split(spark):
    f = group_holdout(M.feature_table(spark, SF_MID)).persist()
    return f.where(F.col("split") == "train_val"), f.where(F.col("split") == "test")


def test_forest_learns_rule_label(spark, split):
    tv, te = split
    model, _ = M.fit(M.make_pipeline("forest", M.model_features(), "rule_class", None, SMALL_FOREST), tv)
    pred = M.predict(model, te, ["rule_class"])
    acc = pred.select(F.avg((F.col("prediction") == F.col("rule_class")).cast("double"))).first()[0]
    majority = te.groupBy("rule_class").count().agg(F.max("count")).first()[0] / te.count()
    assert acc > majority + 0.2
    p = pred.select(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b).alias("s")).agg(
        F.min("s"), F.max("s")).first()
    assert abs(p[0] - 1) < 1e-6 and abs(p[1] - 1) < 1e-6
    imp = M.feature_importance(model, M.model_features(), 15).collect()
    assert len(imp) == 15 and imp[0]["importance"] >= imp[-1]["importance"]


def test_ovr_probabilities_normalised(spark, split):
    tv, te = split
    params = {"n_estimators": 3, "max_depth": 3, "seed": 1}
    model, _ = M.fit(M.make_pipeline("boosted", M.model_features(), "rule_class", None, params), tv)
    pred = M.predict(model, te.limit(50), ["rule_class"])
    s = pred.select(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in s)


def test_save_load_score(spark, split, tmp_path):
    from beaconflow.plans.scoring import score_batch
    tv, _ = split
    model, _ = M.fit(M.make_pipeline("forest", M.model_features(), "rule_class", None, SMALL_FOREST), tv)
    path = str(tmp_path / "model")
    M.save_model(model, path)
    m = load_messages(spark, SF_SMALL).drop("class")
    a = score_batch(m, model).select("row_id", "prediction")
    b = score_batch(m, path).select("row_id", "prediction")
    assert rows(a) == rows(b) and a.count() == m.count()
    with pytest.raises(ValueError):
        score_batch(m.drop("posz"), model)


def test_score_records_uses_history(spark, split):
    from beaconflow.plans.scoring import score_records
    tv, _ = split
    model, _ = M.fit(M.make_pipeline("forest", M.model_features(), "rule_class", None, SMALL_FOREST), tv)
    m = load_messages(spark, SF_SMALL).drop("class")
    last = m.orderBy(F.desc("row_id")).limit(3)
    hist = m.join(last.select("row_id"), "row_id", "left_anti")
    text = last.select("row_id", F.concat_ws(",", *[F.col(c).cast("string") for c in MESSAGE_29]).alias("record"))
    scored, rej = score_records(text, model, history=hist)
    assert scored.count() == 3 and rej.count() == 0
    full = M.predict(model, engineer_features(m, keep=["row_id", *M.FEATURES_8]), ["row_id"])
    assert rows(scored.select("row_id", "prediction")) == rows(
        full.join(last.select("row_id"), "row_id", "left_semi").select("row_id", "prediction"))


def test_stream_equals_batch(spark):
    from beaconflow.plans.catalog import _stream_in_slices
    from beaconflow.streaming.features import stream_features
    # every tenth message has no sender: it keeps its place beside the state
    lose = lambda m: m.withColumn("senderpseudo", F.when(F.col("row_id") % 10 != 0, F.col("senderpseudo")))
    s = _stream_in_slices(spark, SF_SMALL, stream_features, "t-stream", columns=lose)
    b = engineer_features(lose(load_messages(spark, SF_SMALL)), keep=["row_id", "senderpseudo"])
    assert s.count() == b.count() and s.where("senderpseudo is null").count() > 0
    causal = [c for c in ENGINEERED_17 if c not in ("speed_consistency", "position_consistency")]
    assert rows(s, ["row_id"] + causal) == rows(b, ["row_id"] + causal)
    # final running std of each sender = whole-sender std
    last = s.where("senderpseudo is not null").groupBy("senderpseudo").agg(F.max_by("speed_consistency", "row_id").alias("v"))
    whole = b.where("senderpseudo is not null").groupBy("senderpseudo").agg(F.first("speed_consistency").alias("v"))
    assert rows(last) == rows(whole)


def test_feature_search_small(spark, split):
    tv, _ = split
    inner = group_holdout(tv, ratio=0.8, seed=3, names=("train", "valid"), out="inner")
    tr, va = inner.where(F.col("inner") == "train"), inner.where(F.col("inner") == "valid")
    feats = M.model_features()
    r = H.feature_search(tr, va, feats, "rule_class", players=4, generations=2, max_features=6, sampling_rate=0.5,
                         params=SMALL_FOREST, parallelism=2)
    prog = r["progress"].orderBy("generation").collect()
    assert len(prog) == 2 and prog[1]["best_fitness"] >= prog[0]["best_fitness"]
    assert 3 <= len(r["best"]) <= 6
    nb = H.feature_search(tr, va, feats, "rule_class", players=8, generations=2, fitness="naive_bayes",
                          weight_method=None)
    assert nb["candidates"].count() == 16
    # the subset containing posy (the rule's input) must beat one without it under naive Bayes
    iy, others = feats.index("posy"), [feats.index(c) for c in ("posx", "posx_n", "spdy")]
    res = H.naive_bayes_fitness(tr, va, feats, [[iy] + others[:2], others], "rule_class")
    assert res[0]["f1"] > res[1]["f1"]


def test_differential_evolution_minimises(spark):
    import numpy as np
    bounds = [(-5, 5), (-5, 5)]
    f = lambda vs: [float((v[0] - 1) ** 2 + (v[1] + 2) ** 2) for v in vs]
    init = np.array([[0.0, 0.0], [3, 3], [-3, 1], [4, -4], [2, 2], [-1, -1]])
    best, score, hist = H.differential_evolution(f, bounds, init, 30)
    assert score < 0.05 and hist[-1][1] < hist[0][1] / 10
    d = H.decode_params([8.7, 0.071234, 500.9, 0.9, 0.9, 0, 1.6, 0, 1])
    assert d["max_depth"] == 8 and d["n_estimators"] == 500 and d["min_child_weight"] == 1 and d["learning_rate"] == 0.0712


def test_training_run_end_to_end(spark, tmp_path):
    from beaconflow.plans.training import run_training
    from beaconflow.sources.messages import with_rule_class
    m = with_rule_class(load_messages(spark, SF_MID))
    r = run_training(m, label="rule_class", params=SMALL_FOREST, k=3, model_path=str(tmp_path / "model"),
                     runs_path=str(tmp_path / "runs"))
    met = {(x["scope"], x["metric"]): x["value"] for x in r["metrics"].where("scope != 'fold'").collect()}
    assert met[("test", "accuracy")] > 0.8 and r["band"] in {"excellent", "good", "moderate", "severe"}
    assert spark.read.parquet(str(tmp_path / "runs")).where(F.col("run_id") == r["run_id"]).count() > 0
    assert M.load_model(str(tmp_path / "model")) is not None


def test_stream_event_time_reorders_late_messages(spark, tmp_path):
    import time as _t
    from beaconflow.streaming.features import end_of_stream, stream_features
    m = load_messages(spark, SF_SMALL).withColumn("ts", F.timestamp_seconds("sendtime"))
    cols = ["row_id", "senderpseudo", "posx", "posy", "posx_n", "spdx", "spdy", "hedy", "hedx_n", "ts"]
    m = m.select(*cols)
    lo, hi = m.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    src = str(tmp_path / "src")
    # files in time order, but each also carries every 7th message of the *next* slice (arrives early)
    # and holds back every 5th of its own (arrives one file late): out-of-order arrival within 2 slices
    step = (hi - lo) // 6 + 1
    sl = [m.where((F.unix_seconds("ts") >= lo + i * step) & (F.unix_seconds("ts") < lo + (i + 1) * step)) for i in range(6)]
    held = None
    for i in range(6):
        part = sl[i].where(F.pmod("row_id", F.lit(5)) != 0)
        if held is not None:
            part = part.unionByName(held)
        held = sl[i].where(F.pmod("row_id", F.lit(5)) == 0)
        part.coalesce(1).write.mode("append").parquet(src)
        _t.sleep(0.05)
    held.coalesce(1).write.mode("append").parquet(src)
    _t.sleep(0.05)
    end_of_stream(m, "ts", f"{int(1.5 * step)} seconds").coalesce(1).write.mode("append").parquet(src)
    sdf = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = stream_features(sdf, event_time="ts", delay=f"{int(1.5 * step)} seconds")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")  # event times are compared as epochs
    q = (out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination()
    spark.conf.set("spark.sql.session.timeZone", zone)
    s = spark.read.parquet(str(tmp_path / "out"))
    b = engineer_features(load_messages(spark, SF_SMALL), order="sendtime", tiebreak="row_id",
                          keep=["row_id", "senderpseudo"])
    causal = [c for c in ENGINEERED_17 if c not in ("speed_consistency", "position_consistency")]
    emitted = s.select("row_id")
    assert s.count() == b.count()  # the last row lets out what waits behind the watermark
    assert rows(s, ["row_id"] + causal) == rows(b.join(emitted, "row_id", "left_semi"), ["row_id"] + causal)


def test_param_search_resplit_deterministic(spark, split):
    tv, _ = split
    bounds = [(3, 4), (0.05, 0.1), (3, 5), (0.8, 1.0), (0.8, 1.0), (0, 1), (1, 2), (0, 1), (0.5, 1)]
    start = [3, 0.07, 4, 0.9, 0.9, 0, 1, 0, 1]
    r1 = H.param_search(tv, "rule_class", M.model_features(), bounds, start, generations=1, population=4,
                        kind="forest", resplit=True, parallelism=2)
    r2 = H.param_search(tv, "rule_class", M.model_features(), bounds, start, generations=1, population=4,
                        kind="forest", resplit=True, parallelism=2)
    a = sorted((r["run"], round(r["macro_f1"], 9)) for r in r1["runs"].collect())
    b = sorted((r["run"], round(r["macro_f1"], 9)) for r in r2["runs"].collect())
    assert a == b and [x for x, _ in a] == list(range(8))


def test_soft_vote_models_equals_frame_vote(spark, split):
    from beaconflow.operators.evaluate import soft_vote
    tv, te = split
    models = []
    for seed in (1, 2, 3):
        m, _ = M.fit(M.make_pipeline("forest", M.model_features(), "rule_class", None,
                                     {"n_estimators": 5, "max_depth": 4, "seed": seed}), tv)
        models.append(m)
    chained = M.soft_vote_models(models, te, ["row_id"])
    wide = te.select("row_id")
    for i, m in enumerate(models):
        wide = wide.join(M.predict(m, te, ["row_id"]).select("row_id", F.col("probability").alias(f"p{i}")), "row_id")
    grouped = soft_vote(wide, ["p0", "p1", "p2"], ["row_id"])
    assert rows(chained.select("row_id", "prediction")) == rows(grouped.select("row_id", "prediction"))


def test_score_batch_contract_and_file_order(spark, split, tmp_path):
    from beaconflow.plans.scoring import score_batch
    from beaconflow.schema import MESSAGE_29
    tv, _ = split
    model, _ = M.fit(M.make_pipeline("forest", M.model_features(), "rule_class", None, SMALL_FOREST), tv)
    m = load_messages(spark, SF_SMALL).orderBy("row_id")
    with pytest.raises(ValueError):
        score_batch(m, model)  # an extra column (class) breaks the 29-column contract
    p = str(tmp_path / "upload")
    m.select(*MESSAGE_29).coalesce(1).write.parquet(p)
    s = score_batch(spark.read.parquet(p), model)  # no key: file order gives one
    assert sorted(r["row_id"] for r in s.select("row_id").collect()) == list(range(m.count()))
