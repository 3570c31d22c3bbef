"""P3/P9 on growing tables: stored sketches of parts, merged without reading the parts again.

One row for each part and column holds the row count, minimum, maximum, count/mean/M2 moments, a HyperLogLog sketch for distinct
values and a KLL sketch for quantiles (both from Spark's own functions).  New data add rows; the profile of everything is
a merge of the stored rows, whose number is parts x columns whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null

#: Size parameters: 2^14 registers (standard error 1.04 / sqrt(2^14) = 0.8 %), k of the quantile sketch (rank error about 1.3 % at 200, 0.4 % at 800).
LG_REGISTERS, QUANTILE_K = 14, 800
#: Three standard errors of the distinct count, and the rank error that a quantile may have.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_REGISTERS / 2), 0.01


def sketch_rows(df: DataFrame, cols: list[str], part: str) -> DataFrame:
    """``part, feature, n_rows, n, lo, hi, mean, m2, distinct_sketch, quantile_sketch`` for each value of ``part`` and column.

    NaN counts as missing.  One aggregate with partial sketches before the shuffle: rows of a part are never gathered.
    """
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        x = nan_to_null(F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"n_{i}"), F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}"), F.avg(x).alias(f"mean_{i}"),
                 (F.var_pop(x) * F.count(x)).alias(f"m2_{i}"), F.hll_sketch_agg(x.cast("string"), LG_REGISTERS).alias(f"d_{i}"),
                 F.kll_sketch_agg_double(x, F.lit(QUANTILE_K)).alias(f"q_{i}")]
    wide = df.groupBy(F.col(part).alias("part")).agg(*aggs)
    one = [F.struct(F.lit(c).alias("feature"), F.col("n_rows"), *[F.col(f"{a}_{i}").alias(b) for a, b in (
        ("n", "n"), ("lo", "lo"), ("hi", "hi"), ("mean", "mean"), ("m2", "m2"), ("d", "distinct_sketch"), ("q", "quantile_sketch"))])
        for i, c in enumerate(cols)]
    return wide.select("part", F.inline(F.array(*one)))


def merged_profile(stored: DataFrame, probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Describe and distinct counts of everything that ``stored`` rows stand for: ``feature, n_rows, count, mean, std, min, q25, q50, q75, max, n_distinct``.

    Counts, mean, std and extremes are exact; ``n_distinct`` and the quantiles have the errors stated above.  A column without
    values has nulls and 0 distinct values.
    """
    some = F.col("n") > 0
    mean = F.sum(F.when(some, F.col("n") * F.col("mean"))) / F.sum("n")
    total = stored.groupBy("feature").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("count"), F.when(F.sum("n") > 0, mean).alias("mean"), F.min("lo").alias("min"),
        F.max("hi").alias("max"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"),
        F.kll_merge_agg_double("quantile_sketch").alias("_q"))
    # moments by their distance from the common mean
    around = stored.where(some).join(total.select("feature", F.col("mean").alias("_mean")), "feature").groupBy("feature").agg(
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))).alias("_m2"))
    names = [f"q{round(100 * p)}" for p in probs]
    out = total.join(around, "feature", "left").withColumn("std", F.when(F.col("count") > 1, F.sqrt(F.col("_m2") / (F.col("count") - 1))))
    found = [F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("_q", F.lit(float(p)))).alias(n) for p, n in zip(probs, names)]
    return out.select("feature", "n_rows", "count", "mean", "std", "min", *found, "max", F.when(F.col("count") > 0, F.col("n_distinct")).otherwise(0).alias("n_distinct"))
