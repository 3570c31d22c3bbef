"""Data-preparation job: the reference's preprocessing workflow as one Spark job.

lower-case names -> regroup labels -> profile (missing, infinity, duplicates,
distinct counts, class shares) -> drop single-valued columns -> stratified
train/val/test split -> scaler fitted on train only, applied to every split ->
one table partitioned by split (plus the profile tables) written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.labels import regroup
from ..operators.profile import (class_distribution, distinct_counts, drop_zero_variance, numeric_columns,
                                 profile_duplicates, profile_inf, profile_missing)
from ..operators.scaling import apply_scaler, fit_scaler
from ..operators.splits import stratified_split
from ..sources.messages import lower_columns
from ..sources.sinks import write_splits


def run_preparation(raw: DataFrame, out_path: str, key: str = "row_id", label: str = "class",
                    group_label: str = "class_group", test: float = 0.2, val: float = 0.2, seed: int = 42,
                    profile_path: str | None = None) -> dict:
    """Prepare a labelled message table; returns the kept / dropped / scaled column lists."""
    df = regroup(lower_columns(raw), label, group_label)
    if profile_path:
        for name, t in (("missing", profile_missing(df)), ("infinity", profile_inf(df)),
                        ("duplicates", profile_duplicates(df.drop(key))), ("distinct", distinct_counts(df)),
                        ("classes", class_distribution(df, group_label))):
            t.write.mode("overwrite").parquet(f"{profile_path.rstrip('/')}/{name}")
    kept = drop_zero_variance(df)
    dropped = [c for c in df.columns if c not in kept.columns]
    split = stratified_split(kept, group_label, key, test, val, seed)
    scale_cols = [c for c in numeric_columns(kept) if c not in (key, label, group_label)]
    stats = fit_scaler(split.where(F.col("split") == "train"), scale_cols)
    write_splits(apply_scaler(split, stats), out_path)
    return {"kept": kept.columns, "dropped": dropped, "scaled": scale_cols}
