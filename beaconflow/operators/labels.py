"""Label and projection operators L1-L12."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import argmax, pct
from ..schema import CLASS_GROUP, CLASS_NAMES


def map_literal(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def regroup(df: DataFrame, col: str = "class", out: str = "class_group", mapping: dict = CLASS_GROUP,
            strict: bool = False) -> DataFrame:
    """L1: 20 raw ids -> 6 groups.  Unknown id -> NULL, or an error when ``strict``."""
    val = F.element_at(map_literal(mapping), F.col(col))
    if strict:
        val = F.when(F.col(col).isNotNull() & val.isNull(),
                     F.raise_error(F.concat(F.lit("unknown class id: "), F.col(col).cast("string")))).otherwise(val)
    return df.withColumn(out, val.cast("int"))


def with_class_name(df: DataFrame, col: str = "class_group", out: str = "class_name",
                    names: dict = CLASS_NAMES) -> DataFrame:
    """L2: id -> name, default ``Class <id>``."""
    name = F.coalesce(F.element_at(map_literal(names), F.col(col)), F.concat(F.lit("Class "), F.col(col).cast("string")))
    return df.withColumn(out, name)


def onehot_encode(df: DataFrame, col: str, classes: list[int], prefix: str = "class_") -> DataFrame:
    """L3 (encode): one 0/1 column per class."""
    return df.select("*", *[(F.col(col) == F.lit(k)).cast("int").alias(f"{prefix}{k}") for k in classes])


def onehot_decode(df: DataFrame, cols: list[str], out: str = "class") -> DataFrame:
    """L3 (decode): argmax over the one-hot columns, first column wins a tie."""
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    return df.withColumn(out, argmax(arr))


def filter_remap(df: DataFrame, label: str = "class", targets: list[int] | None = None,
                 out: str | None = None) -> tuple[DataFrame, dict, DataFrame]:
    """L4: keep listed classes, remap to 0..m-1 in sorted order.

    Returns (filtered frame, {old: new}, one-row counts: before, after, removed, removed_pct).
    """
    targets = sorted(set(targets or []))
    mapping = {old: new for new, old in enumerate(targets)}
    out = out or label
    kept = df.where(F.col(label).isin(targets)).withColumn(out, F.element_at(map_literal(mapping), F.col(label)).cast("int"))
    counts = df.agg(F.count(F.lit(1)).alias("before"),
                    F.count(F.when(F.col(label).isin(targets), 1)).alias("after"))
    counts = (counts.withColumn("removed", F.col("before") - F.col("after"))
              .withColumn("removed_pct", F.when(F.col("before") > 0, pct("removed", F.greatest("before", F.lit(1)), 1))))
    return kept, mapping, counts


def select_by_position(df: DataFrame, positions: list[int]) -> DataFrame:
    """Project by column position; coerce to double, bad values -> NULL."""
    cols = df.columns
    return df.select(*[F.col(f"`{cols[i]}`").try_cast("double").alias(cols[i]) for i in positions])


def union_splits(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    out = dfs[0]
    for d_ in dfs[1:]:
        out = out.unionByName(d_)
    return out


def fill_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing -> 0."""
    return df.fillna(0.0, subset=cols) if cols else df.fillna(0.0).fillna(0)


def distinct_senders(df: DataFrame, group: str = "senderpseudo") -> DataFrame:
    """L10."""
    return df.select(group).distinct()


def keep_senders(df: DataFrame, senders: DataFrame, group: str = "senderpseudo", keep: bool = True) -> DataFrame:
    """Rows whose sender is (not) in ``senders`` - a semi / anti join."""
    return df.join(senders.select(group), group, "left_semi" if keep else "left_anti")


def sender_overlap(df: DataFrame, group: str = "senderpseudo", split: str = "split") -> DataFrame:
    """Senders seen in more than one split (must be empty)."""
    return (df.groupBy(group).agg(F.count_distinct(split).alias("n_splits"))
            .where(F.col("n_splits") > 1))


def assert_disjoint(df: DataFrame, group: str = "senderpseudo", split: str = "split") -> DataFrame:
    n = sender_overlap(df, group, split).limit(1).count()
    if n:
        raise ValueError(f"sender leakage: some {group} values appear in more than one {split}")
    return df
