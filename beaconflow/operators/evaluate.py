"""Evaluation E1-E9 over a (label, prediction) frame.

Everything starts from the confusion counts (one grouped count over the
predictions); the per-class tables have one row per class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import argmax
from ..functions.ranking import rank_within
from ..schema import GAP_BANDS, GAP_OTHERWISE


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction", by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """Long-form confusion counts (by..., label, prediction, n); a row stands for as many as its column ``n`` says, or for one.

    Rows without a label or without a prediction cannot be judged and are left out, here and so in
    everything that starts from these counts (E1-E6).
    """
    return (df.where(F.col(label).isNotNull() & F.col(pred).isNotNull()).groupBy(*(by or []), F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("prediction"))
            .agg((F.sum(n) if n else F.count(F.lit(1))).alias("n")))


def confusion_wide(df: DataFrame, label: str = "label", pred: str = "prediction", classes: list[int] | None = None):
    c = confusion(df, label, pred)
    return c.groupBy("label").pivot("prediction", classes).sum("n").fillna(0)


def per_class(df: DataFrame, label: str = "label", pred: str = "prediction", by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """Per class over labels seen in truth or prediction: tp, support, predicted, precision, recall, f1."""
    by = by or []
    c = confusion(df, label, pred, by, n)
    truth = c.groupBy(*by, F.col("label").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n"))).alias("tp"))
    predicted = c.groupBy(*by, F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = truth.join(predicted, by + ["cls"], "full_outer").fillna(0, subset=["support", "tp", "predicted"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                    F.lit(0.0))
    return (j.withColumn("precision", prec).withColumn("recall", rec).withColumn("f1", f1)
            .select(*by, F.col("cls").alias("label"), "tp", "support", "predicted", "precision", "recall", "f1"))


def scores(df: DataFrame, label: str = "label", pred: str = "prediction", by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """N, accuracy, macro F1 (plain mean over labels), weighted F1, macro precision / recall."""
    by = by or []
    p = per_class(df, label, pred, by, n)
    return p.groupBy(*by).agg(F.sum("support").alias("n"),
                              (F.sum("tp") / F.sum("support")).alias("accuracy"),
                              F.avg("f1").alias("macro_f1"),
                              (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
                              F.avg("precision").alias("macro_precision"),
                              F.avg("recall").alias("macro_recall"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """E5: rows per class + 'accuracy', 'macro avg', 'weighted avg' (row column ``row``)."""
    p = per_class(df, label, pred)
    cls_rows = p.select(F.col("label").cast("string").alias("row"), "precision", "recall", "f1",
                        F.col("support").cast("long").alias("support"))
    tot = p.agg(F.sum("support").alias("s"), F.sum("tp").alias("tp"),
                F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                F.sum(F.col("precision") * F.col("support")).alias("wp"),
                F.sum(F.col("recall") * F.col("support")).alias("wr"),
                F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = F.col("tp") / F.col("s")
    summary = tot.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("row"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 F.col("s").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("s").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), (F.col("wp") / F.col("s")).alias("precision"),
                 (F.col("wr") / F.col("s")).alias("recall"), (F.col("wf") / F.col("s")).alias("f1"),
                 F.col("s").cast("long").alias("support")))))
    return cls_rows.unionByName(summary)


def gap_band(gap) -> "F.Column":
    """E6 verdict for a CV-minus-test accuracy gap (negative = excellent)."""
    expr = None
    for bound, name in GAP_BANDS:
        expr = F.when(gap < F.lit(bound), F.lit(name)) if expr is None else expr.when(gap < F.lit(bound), F.lit(name))
    return expr.otherwise(F.lit(GAP_OTHERWISE))


def gap_bands(metrics: DataFrame, cv_col: str = "cv_accuracy", test_col: str = "test_accuracy") -> DataFrame:
    """gap = mean CV accuracy - test accuracy, and its band."""
    gap = F.col(cv_col) - F.col(test_col)
    return metrics.withColumn("gap", gap).withColumn("band", gap_band(F.col("gap")))


def fold_summary(metrics: DataFrame, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Mean and 2 * population std of a per-fold metric."""
    g = metrics.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("n_folds"), F.avg(value).alias("mean"),
                 (2 * F.stddev_pop(value)).alias("two_std"))


def baseline_delta(current: DataFrame, baseline: DataFrame, keys: list[str] = ["metric"],
                   value: str = "value") -> DataFrame:
    """Absolute and relative (%) difference to a stored baseline, with a verdict."""
    j = current.select(*keys, F.col(value).alias("current")).join(
        baseline.select(*keys, F.col(value).alias("baseline")), keys, "inner")
    delta = F.col("current") - F.col("baseline")
    return (j.withColumn("delta", delta)
            .withColumn("delta_pct", F.try_divide(delta * 100.0, F.col("baseline")))
            .withColumn("verdict", F.when(delta > 0, "improved").when(delta < 0, "worse").otherwise("equal")))


def soft_vote(df: DataFrame, probs: list[str], keep: list[str]) -> DataFrame:
    """M8: mean class-probability vector over the models' columns of a row, class = argmax (first wins).

    ``probs`` are array<double> columns of equal length; a projection, summed in model order (a fixed
    order, so ties resolve the same way on every run).
    """
    total = F.col(probs[0])
    for c in probs[1:]:
        total = F.zip_with(total, F.col(c), lambda a, b: a + b)
    mean = F.transform(total, lambda v: v / F.lit(float(len(probs))))
    return df.select(*keep, mean.alias("probability")).withColumn("prediction", argmax(F.col("probability")))


def auc_one_vs_rest(pred: DataFrame, label: str = "label", prob: str = "probability") -> DataFrame:
    """Exact ROC AUC of class k against the rest from probability[k], per class, plus their mean.

    Rows are counted per (class, distinct score); the score's rank among the rest comes from running
    totals over range partitions, and AUC is the rank sum with ties counted half.  A class without
    rows of its own or of others has NULL.  Rows without a label are left out.
    """
    long = pred.where(F.col(label).isNotNull()).select(F.col(label).alias("_l"), F.posexplode(prob).alias("_k", "_s"))
    own = F.col("_l") == F.col("_k")
    g = long.groupBy("_k", "_s").agg(F.count_if(own).alias("_pos"), F.count_if(~own).alias("_neg"))
    r = rank_within(g, ["_k"], ["_s"], weight=F.col("_neg"))
    a = r.groupBy("_k").agg(F.sum(F.col("_pos") * (F.col("_rank") + F.col("_w") / 2)).alias("_u"),
                            F.sum("_pos").alias("_p"), F.sum("_w").alias("_n"))
    per = a.select(F.col("_k").cast("string").alias("class"),
                   F.try_divide(F.col("_u"), F.col("_p").cast("double") * F.col("_n")).alias("auc"))
    return per.unionByName(per.agg(F.avg("auc").alias("auc")).select(F.lit("mean").alias("class"), "auc"))
