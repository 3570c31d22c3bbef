"""Standardisation and class weights Z1-Z5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Z1 fit: mean and population std per column (NaN counts as missing), in one aggregate (one row reaches the driver)."""
    x = [nan_to_null(F.col(c).cast("double")) for c in cols]
    row = df.agg(*[F.avg(v).alias(f"m_{i}") for i, v in enumerate(x)],
                 *[F.stddev_pop(v).alias(f"s_{i}") for i, v in enumerate(x)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """Z1 apply: (x - mean) / std, a zero (or undefined) std divides by 1.  Pure projection."""
    out = df
    for c, (m, s) in stats.items():
        div = 1.0 if (s is None or s == 0.0) else float(s)
        mean = 0.0 if m is None else float(m)
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(mean)) / F.lit(div))
    return out


def standardize(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fit on ``fit_on`` (default: ``df``), apply to ``df``."""
    return apply_scaler(df, fit_scaler(fit_on if fit_on is not None else df, cols))


def scaled_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population std per column after scaling (expect 0 / 1 on the fit set)."""
    agg = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"m_{i}").alias("mean"), F.col(f"s_{i}").alias("std"))
               for i, c in enumerate(cols)]
    return agg.select(F.inline(F.array(*structs)))


def class_weights(df: DataFrame, label: str = "class", method: str | None = "balanced") -> DataFrame:
    """Balanced n / (k * n_c) or its square root; k = number of distinct classes.

    ``method`` None (or unknown) gives weight 1.  One row per class.
    """
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    allw = Window.partitionBy()
    base = F.sum("n_c").over(allw) / (F.count(F.lit(1)).over(allw) * F.col("n_c"))
    if method == "balanced":
        w = base
    elif method == "sqrt":
        w = F.sqrt(base)
    else:
        w = F.lit(1.0)
    return g.withColumn("weight", w.cast("double"))


def with_weight(df: DataFrame, weights: DataFrame, label: str = "class", out: str = "weight") -> DataFrame:
    """Row weight from its class, by a left join with the class table (a row without a class gets NULL).

    The table has one row per class and is broadcast: a shuffle by class would put all rows of a class into one task.
    """
    w = weights.select(F.col(label).alias("_class"), F.col("weight").alias(out))
    return df.join(F.broadcast(w), df[label] == w["_class"], "left").drop("_class")
