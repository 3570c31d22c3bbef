"""Scoring Q1-Q5 and the prediction export S8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import file_order_index, rank_within
from ..operators.features import engineer_features
from ..schema import FEATURES_8, MESSAGE_29
from ..sources.messages import check_contract, parse_records, select_features


def export_table(pred: DataFrame, order: str = "row_id", prob: str = "probability",
                 label: str = "prediction") -> DataFrame:
    """Row (1-based, input order), 'Class n', confidence 'xx.xx%', probabilities '0.1234;...'.

    Row numbers come from the distributed ranking, not a single-task window.
    """
    r = rank_within(pred, [], [order])
    return r.select(
        (F.col("_rank") + 1).cast("long").alias("row"),
        F.concat(F.lit("Class "), F.col(label).cast("string")).alias("predicted_class"),
        F.format_string("%.2f%%", F.array_max(prob) * 100).alias("confidence"),
        F.array_join(F.transform(prob, lambda x: F.format_string("%.4f", x)), ";").alias("probabilities"))


def preview(pred: DataFrame, n: int = 100, order: str = "row_id") -> DataFrame:
    """Q3/Q5: first ``n`` rows by input order (a top-k, no full sort), total count and a 'more' flag."""
    total = pred.select(F.count(F.lit(1))).scalar()
    head = pred.orderBy(order).limit(n)
    return head.withColumn("n_total", total.cast("long")).withColumn("has_more", total > F.lit(n))


def score_batch(df: DataFrame, model, key: str = "row_id", order: str = "row_id", group: str = "senderpseudo",
                bucket_width: float | None = None) -> DataFrame:
    """Q1: 29-column contract -> 8 columns -> 17 sequence features -> saved pipeline -> class + probabilities.

    ``model`` is a fitted ``PipelineModel`` (scaler + classifier) or a path to one.
    Besides ``key`` the input must have exactly the 29 message columns (any order).
    Input order is kept through ``key`` (derived from file order when absent);
    nothing is collected.
    """
    if key not in df.columns:  # keep the input order: a dense index in file order, no sort
        df = file_order_index(df, key)
    return scored(features_of(df, key, order, group, bucket_width), model, key)


def features_of(df: DataFrame, key: str, order: str, group: str, bucket_width: float | None = None) -> DataFrame:
    """``key`` and the model features of messages that have exactly the 29 message columns besides ``key``."""
    check_contract(df.drop(key))  # in any order
    base = select_features(df, [key] + [c for c in FEATURES_8 if c != key])
    return engineer_features(base, group=group, order=order, bucket_width=bucket_width)


def scored(feats: DataFrame, model, key: str) -> DataFrame:
    """Class and probabilities by a fitted pipeline or its path; Q4: confidence in % with 2 decimals, per-class % with 1."""
    from .models import load_model, predict
    pred = predict(load_model(model) if isinstance(model, str) else model, feats, [key])
    return (pred.withColumn("confidence", F.round(F.array_max("probability") * 100, 2))
            .withColumn("class_pct", F.transform("probability", lambda p: F.round(p * 100, 1))))


def score_records(records: DataFrame, model, history: DataFrame | None = None, col: str = "record",
                  key: str = "row_id", group: str = "senderpseudo") -> tuple[DataFrame, DataFrame]:
    """Q2: text records -> typed rows (rejects kept apart) -> scored.

    A record alone has no previous message, so when ``history`` (earlier messages
    with the same columns and ``key``) is given the records are placed after their
    sender's history before the sequence features are computed; only the new
    records are returned.
    """
    good, rejects = parse_records(records, col, keep=[key])
    # Parsed records are a small, stable input; a reliable checkpoint keeps the parse
    # expressions out of the union + window + semi-join plan that follows.
    good = good.checkpoint(eager=True)
    if history is None:
        return score_batch(good, model, key=key), rejects
    # only the records' senders matter, and only the new rows are scored
    senders = good.select(group).distinct()
    past = history.select(key, *MESSAGE_29).join(senders, group, "left_semi")
    feats = features_of(past.unionByName(good.select(key, *MESSAGE_29)), key, key, group)
    return scored(feats.join(good.select(key), key, "left_semi"), model, key), rejects
