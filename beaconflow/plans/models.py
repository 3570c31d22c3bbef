"""Models M1-M10 as Spark ML pipelines.

A pipeline is assembler -> standard scaler -> classifier, fitted and saved as
one ``PipelineModel`` (scaler and model together).  Metrics come from the
``operators.evaluate`` aggregations (macro F1 has no built-in evaluator).
Folds are fitted from one persisted feature frame; the fold loop is a short
driver loop whose every step is a distributed Spark job (optionally several
in parallel, as ``CrossValidator(parallelism=...)`` does).
"""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import scores, soft_vote
from ..operators.features import engineer_features
from ..operators.labels import regroup
from ..schema import ENGINEERED_25, FEATURES_8
from ..sources.messages import load_messages, with_rule_class
from .boosting import SETTINGS, fit_boosted
from .fourier import FourierSVC, RandomFourier
from .node_table import NodeModel, score_nodes

# Reference model settings (fixed values): boosted trees of the final model, of the
# feature search, and the forest.
BOOSTED_FINAL = dict(max_depth=8, learning_rate=0.068, n_estimators=501, subsample=0.92, colsample_bytree=0.80, seed=42)
BOOSTED_SEARCH = dict(max_depth=15, learning_rate=0.05, n_estimators=100, subsample=0.8, colsample_bytree=0.8, seed=42)
LEAF_WISE_SEARCH = BOOSTED_SEARCH | {"max_leaves": 31}
FOREST = dict(n_estimators=100, max_depth=10, seed=42)


#: Rows of a partition that a fit reads whole, again and again: a forest of 100 trees keeps about 1 KB for each.
ROWS_PER_TASK = 250_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` dealt out evenly over as many partitions as its ``rows`` (counted if not given) need, whatever join made them."""
    rows = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages -> regrouped label + learnable rule label -> 25 model features."""
    m = with_rule_class(regroup(load_messages(spark, sf_dir)))
    keep = ["row_id", *FEATURES_8, "class_group", "rule_class"]
    return engineer_features(m, keep=keep)


def model_features(drop_id: bool = False) -> list[str]:
    return [c for c in ENGINEERED_25 if not (drop_id and c == "senderpseudo")]


#: Settings that each kind of model takes; others are refused rather than ignored.
PARAMS_OF = {
    "forest": {"n_estimators", "max_depth", "subsample", "colsample_bytree", "seed"},
    "boosted": {"n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree", "gamma", "min_child_weight", "seed"},
    "tree": {"max_depth", "seed"}, "logreg": {"max_iter", "reg_lambda", "seed"}, "svc_ovr": {"max_iter", "seed"},
    "svc_rbf": {"max_iter", "dims", "rbf_gamma", "reg_lambda", "seed"},
    "mlp": {"max_iter", "hidden", "seed"},
}
PARAMS_OF["gbt_ovr"] = PARAMS_OF["boosted"]
PARAMS_OF["softmax"] = set(SETTINGS)


def _depth(v) -> int:
    """Spark's trees have 1 to 30 levels below the root."""
    if not 1 <= int(v) <= 30:
        raise ValueError(f"max_depth {v} is not between 1 and 30")
    return int(v)


# Tree learners: node ids cached between levels (checkpointed every 10 iterations into the
# session's checkpoint folder) and 1 GB for split statistics per pass, so deep trees need fewer passes.
TREE_EXEC = dict(cacheNodeIds=True, maxMemoryInMB=1024)
# Classes of a one-vs-rest model fitted side by side: their many short passes overlap; each class keeps its rows (200 bytes each) meanwhile.
CLASSES_AT_ONCE = 3


def make_classifier(kind: str, label: str, weight: str | None, params: dict | None = None, n_features: int = 25,
                    n_classes: int = 6, features: str = "features"):
    p = dict(params or {})
    if kind not in PARAMS_OF:
        raise ValueError(f"unknown model kind {kind!r}")
    if unused := sorted(set(p) - PARAMS_OF[kind]):
        raise ValueError(f"a {kind} model has no settings {unused}")
    seed = int(p.get("seed", 42))
    common = dict(featuresCol=features, labelCol=label)
    if kind == "forest":
        clf = RandomForestClassifier(numTrees=int(p.get("n_estimators", FOREST["n_estimators"])),
                                     maxDepth=_depth(p.get("max_depth", FOREST["max_depth"])), seed=seed,
                                     subsamplingRate=float(p.get("subsample", 1.0)),
                                     featureSubsetStrategy=str(p.get("colsample_bytree", "auto")), **TREE_EXEC,
                                     **common)
    elif kind in ("boosted", "gbt_ovr"):
        d = BOOSTED_FINAL
        gbt = GBTClassifier(maxDepth=_depth(p.get("max_depth", d["max_depth"])),
                            stepSize=float(p.get("learning_rate", d["learning_rate"])),
                            maxIter=int(p.get("n_estimators", d["n_estimators"])),
                            subsamplingRate=float(p.get("subsample", d["subsample"])),
                            featureSubsetStrategy=str(p.get("colsample_bytree", d["colsample_bytree"])),
                            minInfoGain=float(p.get("gamma", 0.0)),
                            # a leaf's least weight, with every row weighing one
                            minInstancesPerNode=max(1, math.ceil(float(p.get("min_child_weight", 1.0)))),
                            # one tree at a time: walking it again costs less than keeping each row's node
                            seed=seed, checkpointInterval=10, featuresCol=features, **(TREE_EXEC | {"cacheNodeIds": False}))
        clf = OneVsRest(classifier=gbt, parallelism=CLASSES_AT_ONCE, **common)
    elif kind == "tree":
        clf = DecisionTreeClassifier(maxDepth=_depth(p.get("max_depth", 10)), seed=seed, **TREE_EXEC, **common)
    elif kind == "logreg":
        clf = LogisticRegression(maxIter=int(p.get("max_iter", 100)), regParam=float(p.get("reg_lambda", 0.0)),
                                 family="multinomial", **common)
    elif kind == "svc_ovr":
        clf = OneVsRest(classifier=LinearSVC(maxIter=int(p.get("max_iter", 50)), featuresCol=features), parallelism=CLASSES_AT_ONCE, **common)
    elif kind == "svc_rbf":  # on random Fourier features, see make_pipeline
        clf = FourierSVC(inputCol=features, featuresCol="fourier", labelCol=label, dims=int(p.get("dims", 256)), gamma=float(p.get("rbf_gamma", 0.0)),
                         seed=seed, maxIter=int(p.get("max_iter", 50)), regParam=float(p.get("reg_lambda", 1e-4)))
    elif kind == "mlp":
        hidden = int(p.get("hidden", 32))
        clf = MultilayerPerceptronClassifier(layers=[n_features, hidden, n_classes], maxIter=int(p.get("max_iter", 100)),
                                             seed=seed, **common)
        weight = None  # no weight column support
    if weight and hasattr(clf, "setWeightCol"):
        clf.setWeightCol(weight)
    return clf


def make_pipeline(kind: str = "forest", features: list[str] | None = None, label: str = "label",
                  weight: str | None = None, params: dict | None = None, n_classes: int = 6) -> Pipeline:
    features = features or model_features()
    asm = VectorAssembler(inputCols=features, outputCol="_raw_features", handleInvalid="keep")
    scaler = StandardScaler(inputCol="_raw_features", outputCol="features", withMean=True, withStd=True)
    clf = make_classifier(kind, label, weight, params, len(features), n_classes)
    if kind == "svc_rbf":
        p = params or {}
        spread = RandomFourier(inputCol="features", outputCol="fourier", dims=int(p.get("dims", 256)), gamma=float(p.get("rbf_gamma", 0.0)),
                               seed=int(p.get("seed", 42)))
        return Pipeline(stages=[asm, scaler, spread, clf])
    return Pipeline(stages=[asm, scaler, clf])


def with_probability(pred: DataFrame) -> DataFrame:
    """M5: ``probability`` as array<double>; for one-vs-rest models (no probability column)
    a normalised logistic of the per-class margins, documented as uncalibrated."""
    if "probability" in pred.columns:
        return pred.withColumn("probability", vector_to_array("probability"))
    raw = vector_to_array("rawPrediction")
    sig = F.transform(raw, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * m)))
    tot = F.aggregate(sig, F.lit(0.0), lambda a, b: a + b)
    return pred.withColumn("probability", F.transform(sig, lambda s: s / tot))


def predict(model: PipelineModel | NodeModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """M4/M5: prediction and class probabilities (argmax of the vector is the class), by a pipeline or a node table."""
    if isinstance(model, NodeModel):
        return score_nodes(model, df, keep)
    out = with_probability(model.transform(df))
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"), "probability")


def fit(pipeline: Pipeline, df: DataFrame, persist: bool = True) -> tuple[PipelineModel, float]:
    """Fit with the input persisted for the fit's several passes (scaler, split finding, tree levels).

    ``persist=False`` where the input is a filter of a persisted frame: no second copy is kept.
    """
    t = time.time()
    cached = not persist or df.storageLevel != StorageLevel.NONE
    if not cached:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = pipeline.fit(df)
    finally:
        if not cached:
            df.unpersist()
    return model, time.time() - t


def fit_kind(kind: str, df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, params: dict | None = None,
             n_classes: int = 6, persist: bool = True) -> tuple[PipelineModel | NodeModel, float]:
    """A fitted model of any kind and its seconds; ``softmax`` is the regularised boosting of ``plans.boosting``."""
    if kind != "softmax":
        return fit(make_pipeline(kind, features, label, weight, params, n_classes), df, persist)
    t = time.time()
    return fit_boosted(df, features, label, weight, params, n_classes), time.time() - t


def cross_validate(df: DataFrame, kind: str = "forest", label: str = "label", fold_col: str = "fold",
                   weight: str | None = None, params: dict | None = None, features: list[str] | None = None,
                   test: DataFrame | None = None, key: str = "row_id", parallelism: int = 1) -> dict:
    """M6 (+M8): fit one model per group fold; per-fold accuracy / macro F1 / sizes; optional
    soft-vote ensemble of the fold models on ``test``.

    Returns {"metrics": DataFrame(fold, metric, value), "models": [...], "vote": DataFrame | None}.
    """
    spark = df.sparkSession
    df = spread(df).persist(StorageLevel.MEMORY_AND_DISK)
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect() if r[0] is not None)  # k values
    pipe = make_pipeline(kind, features, label, weight, params)

    def run(i):
        tr, va = df.where(F.col(fold_col) != i), df.where(F.col(fold_col) == i)
        model, secs = fit(pipe, tr, persist=False)
        s = scores(predict(model, va, [label]), label, "prediction").first()
        rows = [(i, "accuracy", float(s["accuracy"])), (i, "macro_f1", float(s["macro_f1"])),
                (i, "weighted_f1", float(s["weighted_f1"])), (i, "n_valid", float(s["n"])),
                (i, "train_seconds", float(secs))]
        return model, rows

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        results = list(ex.map(run, folds))
    metrics = spark.createDataFrame([r for _, rows in results for r in rows], "fold int, metric string, value double")
    models = [m for m, _ in results]
    vote = None
    if test is not None:
        vote = soft_vote_models(models, test, [key, label])
    df.unpersist()
    return {"metrics": metrics, "models": models, "vote": vote}


def _renamed(model: PipelineModel, i: int) -> PipelineModel:
    """Copy of a fitted assembler -> scaler [-> Fourier map] -> classifier pipeline writing ``_*_{i}`` columns."""
    asm, scaler, *maps, clf = [st.copy() for st in model.stages]
    asm.setOutputCol(f"_raw_{i}")
    scaler.setInputCol(f"_raw_{i}").setOutputCol(f"_feat_{i}")
    for m in maps:
        m._set(inputCol=f"_feat_{i}", outputCol=f"_map_{i}")
    clf.setFeaturesCol(f"_map_{i}" if maps else f"_feat_{i}").setPredictionCol(f"_pred_{i}").setRawPredictionCol(f"_rawp_{i}")
    for inner in getattr(clf, "models", []):  # of a one-vs-rest model: they read and write columns themselves
        inner.setFeaturesCol(clf.getFeaturesCol()).setRawPredictionCol(f"_rawp_{i}")
    if hasattr(clf, "setProbabilityCol"):
        clf.setProbabilityCol(f"_prob_{i}")
    return PipelineModel([asm, scaler, *maps, clf])


def _probability_of(df: DataFrame, i: int):
    if f"_prob_{i}" in df.columns:
        return vector_to_array(f"_prob_{i}")
    raw = vector_to_array(f"_rawp_{i}")
    sig = F.transform(raw, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * m)))
    tot = F.aggregate(sig, F.lit(0.0), lambda a, b: a + b)
    return F.transform(sig, lambda v: v / tot)


def soft_vote_models(models: list[PipelineModel], df: DataFrame, keep: list[str]) -> DataFrame:
    """M8 without a shuffle: the k fitted pipelines score the same rows one after another
    (per-model column names), and the probability vectors are averaged row-wise in model
    order; class = argmax (first wins)."""
    out = df
    for i, m in enumerate(models):
        out = _renamed(m, i).transform(out)
        out = out.withColumn(f"_vote_{i}", _probability_of(out, i))
    return soft_vote(out, [f"_vote_{i}" for i in range(len(models))], keep)


def feature_importance(model: PipelineModel, features: list[str], top: int = 15) -> DataFrame:
    """M9: tree-ensemble feature importances, top ``top`` descending (a k-row table)."""
    spark = SparkSession.getActiveSession()
    clf = model.stages[-1]
    if hasattr(clf, "featureImportances"):
        imp = clf.featureImportances.toArray().tolist()
    else:  # one-vs-rest: mean over the per-class models
        per = [m.featureImportances.toArray() for m in clf.models]
        imp = [float(sum(col) / len(per)) for col in zip(*per)]
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(top)


def compare_models(train: DataFrame, test: DataFrame, kinds: list[str], label: str = "label",
                   weight: str | None = None, params: dict | None = None, features: list[str] | None = None) -> DataFrame:
    """Fit each model kind on the same persisted split; accuracy, macro F1, weighted F1, training time."""
    spark = train.sparkSession
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    for kind in kinds:
        model, secs = fit_kind(kind, train, features or model_features(), label, weight, (params or {}).get(kind))
        s = scores(predict(model, test, [label]), label, "prediction").first()
        rows.append((kind, float(s["accuracy"]), float(s["macro_f1"]), float(s["weighted_f1"]), float(secs)))
    train.unpersist()
    return spark.createDataFrame(rows, "model string, accuracy double, macro_f1 double, weighted_f1 double, "
                                       "train_seconds double")


def save_model(model: PipelineModel, path: str) -> None:
    """Scaler and classifier saved together."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

