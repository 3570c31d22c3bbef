"""Profiling operators P1-P14.  Each returns a small long-form table.

Every per-column statistic is computed in one aggregate pass (partial
aggregation on the executors), never with one scan per column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null
from ..functions.ranking import rank_within, values_at_ranks

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def _long(df: DataFrame, cols: list[str], prefix_map: dict[str, str]) -> DataFrame:
    """One-row wide aggregate -> one row per column (column, metric...)."""
    structs = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{p}__{c}").alias(m) for p, m in prefix_map.items()])
               for c in cols]
    return df.select(F.inline(F.array(*structs)))


def profile_head(df: DataFrame, n: int = 5, order: str = "row_id") -> DataFrame:
    """First n rows by an explicit order (top-k; no global sort of the table)."""
    return df.orderBy(order).limit(n)


def profile_info(df: DataFrame) -> DataFrame:
    """Type and non-null count per column."""
    cols = df.columns
    agg = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"nn__{c}") for c in cols])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = _long(agg, cols, {"nn": "non_null"})
    return out.withColumn("dtype", F.element_at(F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))]),
                                                F.col("feature")))


def profile_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULL or NaN per column (infinity is not missing)."""
    cols = cols or df.columns
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    exprs = []
    for c in cols:
        miss = F.col(c).isNull() | F.isnan(F.col(c)) if c in fl else F.col(c).isNull()
        exprs.append(F.count_if(miss).alias(f"m__{c}"))
    return _long(df.agg(*exprs), cols, {"m": "n_missing"})


def profile_inf(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P5: +/-infinity per numeric column."""
    cols = cols or numeric_columns(df)
    exprs = [F.count_if(F.abs(F.col(c).cast("double")) == F.lit(float("inf"))).alias(f"i__{c}") for c in cols]
    return _long(df.agg(*exprs), cols, {"i": "n_inf"})


def profile_duplicates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each identical group (NULL = NULL, NaN = NaN)."""
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
                 F.count_if(F.col("_c") > 1).cast("long").alias("n_duplicated_groups"))


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The duplicate rows themselves (copies beyond the first), one row per group with its extra count."""
    cols = cols or df.columns
    return (df.groupBy(*cols).agg((F.count(F.lit(1)) - 1).alias("n_extra_copies"))
            .where(F.col("n_extra_copies") > 0))


def class_distribution(df: DataFrame, label: str = "class") -> DataFrame:
    """Count and share (%) per class; the class table is small (one row per class)."""
    from ..functions.columns import pct
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy())
    return g.withColumn("pct", pct(F.col("n"), tot, 2))


def class_order(df: DataFrame, label: str = "class") -> DataFrame:
    """Classes by frequency (descending, ties by id)."""
    return class_distribution(df, label).orderBy(F.desc("n"), F.col(label))


def class_distribution_by_split(df: DataFrame, label: str = "class", split: str = "split",
                                names: dict | None = None) -> DataFrame:
    """Per split and class, per split, per class, and total, via GROUPING SETS.

    With ``names`` ({id: name}) a ``class_name`` column is added (``Class <id>`` for
    unknown ids, NULL on the split and total lines).
    """
    out = df.groupingSets([[split, label], [split], [label], []], split, label).agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.grouping_id(split, label).cast("int").alias("level"))
    out = out.select(F.col(split).alias("split"), F.col(label).alias("class"), "n", "level")
    tot = F.sum(F.when(F.col("level") == 3, F.col("n"))).over(Window.partitionBy())
    split_tot = F.max(F.when(F.col("level") == 1, F.col("n"))).over(Window.partitionBy("split"))
    from ..functions.columns import pct
    out = (out.withColumn("pct_of_split", F.when(F.col("level") == 0, pct(F.col("n"), split_tot, 2)))
           .withColumn("pct_of_total", pct(F.col("n"), tot, 2)))
    if names is not None:
        from .labels import with_class_name
        out = with_class_name(out, "class", "class_name", names).withColumn(
            "class_name", F.when(F.col("class").isNotNull(), F.col("class_name")))
    return out


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-missing values per column (NaN counts as missing).

    Exact form: values are exploded into narrow (column, value) pairs (floats as double,
    integers as long, everything else as string), de-duplicated by a grouped aggregate and
    counted per column - two partial aggregates instead of one ``count(DISTINCT)``
    per column (which would copy every row once per column).  ``approx=True``
    uses HyperLogLog sketches in one pass.
    """
    cols = cols or df.columns
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}

    def v(c):
        return F.nanvl(F.col(c), F.lit(None).cast("double")) if c in fl else F.col(c)
    if approx:
        return _long(df.agg(*[F.approx_count_distinct(v(c)).alias(f"d__{c}") for c in cols]), cols,
                     {"d": "n_distinct"})
    spark = df.sparkSession
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))}

    def slots(c):
        """The value in the slot of its kind: a long above 2**53 has no exact double."""
        kind = "num" if c in fl else "whole" if c in whole else "str"
        return [(v(c).cast(t) if k == kind else F.lit(None).cast(t)).alias(k)
                for k, t in (("num", "double"), ("whole", "long"), ("str", "string"))]
    # one scan: each pair carries its value in one of three slots
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *slots(c)) for c in cols]))).where(
        F.coalesce(F.col("num").cast("string"), F.col("whole").cast("string"), F.col("str")).isNotNull())
    counted = long.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = spark.createDataFrame([(c,) for c in cols], "feature string")  # columns without values count 0
    return names.join(counted, "feature", "left").select(
        "feature", F.coalesce(F.col("n_distinct"), F.lit(0)).cast("long").alias("n_distinct"))


def zero_variance(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns with exactly one distinct non-missing value (all-missing columns are kept).

    ``n_distinct == 1`` is ``count > 0 and min == max`` after NaN -> NULL: one cheap
    aggregate instead of a distinct count per column.
    """
    cols = cols or df.columns
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}

    def v(c):
        return F.nanvl(F.col(c), F.lit(None).cast("double")) if c in fl else F.col(c)
    aggs = []
    for c in cols:
        aggs += [F.count(v(c)).alias(f"n__{c}"), (F.min(v(c)) == F.max(v(c))).alias(f"eq__{c}")]
    out = _long(df.agg(*aggs), cols, {"n": "n", "eq": "eq"})
    return (out.where((F.col("n") > 0) & F.col("eq"))
            .select("feature", F.lit(1).cast("long").alias("n_distinct")))


def drop_zero_variance(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    drop = [r["feature"] for r in zero_variance(df, cols).collect()]  # at most one row per column
    return df.drop(*drop)


def variance_topk(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """Sample variance per column, lowest first, first k (ties by name)."""
    agg = df.agg(*[F.var_samp(nan_to_null(F.col(c).cast("double"))).alias(f"v__{c}") for c in cols])
    # Rank on the normalised value so that mathematically equal variances tie and fall back to the name.
    from ..functions.columns import r6
    return _long(agg, cols, {"v": "variance"}).orderBy(r6("variance"), "feature").limit(k)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation, long form (col_a <= col_b, upper triangle).

    A pair uses the rows where both values are present (NaN counts as missing).  Every task turns its rows into
    counts, means and co-moments of all pairs with a few matrix products, about a point near its own rows (so that large
    offsets such as epoch seconds do not cancel digits), and emits one row per pair; the rows of the tasks are merged by
    their distance from the common mean.  One scan of the data.  A constant column gives NULL.
    """
    x = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    a, b, k = [i for i, _ in pairs], [j for _, j in pairs], len(cols)

    def moments(batches):
        import numpy as np
        import pyarrow as pa
        total, shift = np.zeros((6, k, k)), None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            here = ~np.isnan(v)
            if shift is None:  # a point near this task's rows
                low = np.where(here & np.isfinite(v), v, 0.0)
                shift = low.sum(axis=0) / np.maximum((here & np.isfinite(v)).sum(axis=0), 1)
            m, v = here.astype(float), np.where(here, v - shift, 0.0)
            total += np.stack([m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v])
        if shift is not None:
            n, sx, sy, sxx, syy, sxy = total[:, a, b]
            some = n > 0
            one = np.maximum(n, 1)
            out = [n, shift[a], shift[b], sx / one, sy / one, sxx - sx * sx / one, syy - sy * sy / one, sxy - sx * sy / one]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a)[some], pa.int32()), pa.array(np.array(b)[some], pa.int32()),
                                              *[pa.array(t[some]) for t in out]], names=["a", "b", *names])

    # a task's mean is its point (p) and the small rest (d): differences of means keep their digits
    names = ["n", "px", "py", "dx", "dy", "cxx", "cyy", "cxy"]
    s = x.mapInArrow(moments, "a int, b int, " + ", ".join(f"{c} double" for c in names))
    pair = Window.partitionBy("a", "b")  # a row for each task
    s = s.withColumn("_n", F.sum("n").over(pair))
    s = s.withColumns({f"_r{v}": F.col(f"p{v}") - F.min(f"p{v}").over(pair) + F.col(f"d{v}") for v in "xy"})
    s = s.withColumns({f"_d{v}": F.col(f"_r{v}") - F.sum(F.col("n") * F.col(f"_r{v}")).over(pair) / F.col("_n") for v in "xy"})
    s = s.groupBy("a", "b").agg(
        F.max("_n").alias("n"), *[F.sum(F.col(f"c{u}{v}") + F.col("n") * F.col(f"_d{u}") * F.col(f"_d{v}")).alias(f"s{u}{v}") for u, v in ("xx", "yy", "xy")],
        *[F.max(F.abs(f"p{v}")).alias(f"_m{v}") for v in "xy"])

    def spread(sq, at):  # rounding noise of a constant column counts as none
        noise = F.col("n") * F.pow(F.lit(1e-14) * F.col(at), F.lit(2))
        return F.when((F.col(sq) > noise) & (F.col(sq) > 0), F.col(sq))
    r = F.try_divide(F.col("sxy"), F.sqrt(spread("sxx", "_mx")) * F.sqrt(spread("syy", "_my")))
    name = F.array(*[F.lit(c) for c in cols])
    return s.select(name[F.col("a")].alias("col_a"), name[F.col("b")].alias("col_b"),
                    F.when(r > 1, F.lit(1.0)).when(r < -1, F.lit(-1.0)).when(~F.isnan(r), r).alias("corr"))


def histogram(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """P10: equal-width bins between min and max, last bin closed on the right.

    A constant column spans [v-0.5, v+0.5] (so its values land in the middle bin).
    One wide aggregate for the ranges (one row per column, broadcast), then one
    grouped count over (column, bin) of the exploded values.
    """
    def v(c):
        x = F.col(c).cast("double")
        return F.nanvl(x, F.lit(None).cast("double"))
    rng = _long(df.agg(*[F.min(v(c)).alias(f"lo__{c}") for c in cols], *[F.max(v(c)).alias(f"hi__{c}") for c in cols]),
                cols, {"lo": "vmin", "hi": "vmax"})
    rng = (rng.withColumn("lo", F.when(F.col("vmin") == F.col("vmax"), F.col("vmin") - 0.5).otherwise(F.col("vmin")))
           .withColumn("hi", F.when(F.col("vmin") == F.col("vmax"), F.col("vmax") + 0.5).otherwise(F.col("vmax")))
           .select("feature", "lo", "hi"))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), v(c).alias("value"))
                                         for c in cols]))).where(F.col("value").isNotNull())
    j = long.join(F.broadcast(rng), "feature")  # one row per column: bounded
    b = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    g = j.groupBy("feature", b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return g.select("feature", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), "n")


def _long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """The values that are there, each with the number of its column."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(i).cast("short").alias("feature"), F.col(c).cast("double").alias("value"))
                                        for i, c in enumerate(cols)]))).where(F.col("value").isNotNull() & ~F.isnan("value"))


def _pick_and_interpolate(ranked: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """targets: keys + p, _h, _fl, _r0, _r1 (ranks inside ``ranked``'s groups) -> (feature, p, value)."""
    extra = [c for c in ("p", "_h", "_fl") if c not in keys]
    tl = targets.select(*keys, *extra, F.col("_r0").alias("_target"), F.lit(0).alias("_side"))
    th = targets.select(*keys, *extra, F.col("_r1").alias("_target"), F.lit(1).alias("_side"))
    hits = values_at_ranks(ranked, keys, tl.unionByName(th), ["value"])
    piv = hits.groupBy("feature", "p", "_h", "_fl").agg(
        F.max(F.when(F.col("_side") == 0, F.col("value"))).alias("v0"),
        F.max(F.when(F.col("_side") == 1, F.col("value"))).alias("v1"))
    frac = F.col("_h") - F.col("_fl")
    return piv.select("feature", "p", (F.col("v0") + (F.col("v1") - F.col("v0")) * frac).alias("value"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (h = (n-1)p).

    Values are counted per (column, value) first, with partial aggregation, so a value that most rows
    share is one row; the distinct values are ranked over range partitions with their counts as
    weights, and the two ranks around each h are read.  One path at every size.  Columns go by their number; the names
    come back at the end.
    """
    named = F.array(*[F.lit(c) for c in cols])
    long = _long_values(df, cols)
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_within(vc, ["feature"], ["value"], weight=F.col("_n"))
    n = ranked.groupBy("feature").agg(F.sum("_w").alias("_cnt"))  # from the ranked table, no extra scan
    t = n.select("feature", "_cnt", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    t = t.withColumn("_h", (F.col("_cnt") - 1) * F.col("p")).withColumn("_fl", F.floor("_h").cast("long"))
    t = t.withColumn("_r0", F.col("_fl")).withColumn("_r1", F.least(F.col("_fl") + 1, F.col("_cnt") - 1))
    return _pick_and_interpolate(ranked, ["feature"], t).withColumn("feature", F.get(named, F.col("feature").cast("int")))


def profile_describe(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, std (ddof 1), min, 25/50/75 % (linear interpolation), max.

    ``exact=False`` uses ``percentile_approx`` sketches (single pass) instead of
    the distributed exact ranking.
    """
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        x = F.nanvl(x, F.lit(None).cast("double"))
        aggs += [F.count(x).alias(f"count__{c}"), F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"std__{c}"),
                 F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}")]
        if not exact:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 100000).alias(f"q__{c}"))
    base = _long(df.agg(*aggs), cols, {"count": "count", "mean": "mean", "std": "std", "min": "min", "max": "max",
                                       **({} if exact else {"q": "q"})})
    if not exact:
        return base.select("feature", "count", "mean", "std", "min", F.col("q")[0].alias("q25"),
                           F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("feature").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                                   for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return base.join(qw, "feature", "left").select("feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
