import math

import pytest
from pyspark.sql import functions as F

from beaconflow.operators.features import engineer_features
from beaconflow.schema import ENGINEERED_17
from beaconflow.sources.messages import load_messages
from conftest import SF_SMALL, rows
from simple_features import engineer_features_simple

COLS = ["row_id", "senderpseudo"] + ENGINEERED_17


def _frame(spark, data):
    schema = "row_id long, senderpseudo long, spdx double, spdy double, posx double, posy double, hedy double, hedx_n double"
    return spark.createDataFrame(data, schema)


def test_bucketed_equals_whole_sender_window(spark):
    m = load_messages(spark, SF_SMALL)
    simple = engineer_features_simple(m)
    for width in (3.0, 17.0, 1e9):
        fast = engineer_features(m, bucket_width=width)
        assert rows(fast, COLS) == rows(simple, COLS), width


def test_repartitioning_does_not_change_features(spark):
    m = load_messages(spark, SF_SMALL)
    a = engineer_features(m, bucket_width=5.0)
    b = engineer_features(m.repartition(7, "row_id"), bucket_width=5.0)
    assert rows(a, COLS) == rows(b, COLS)


def test_edge_senders(spark):
    data = [
        (1, 10, 1.0, 0.0, 0.0, 0.0, 0.1, 1.0),
        (2, 10, 2.0, 0.0, 3.0, 4.0, 0.2, 1.0),
        (3, 10, 4.0, 0.0, 3.0, 4.0, 0.5, 1.0),
        (4, 20, 5.0, 5.0, 1.0, 1.0, 0.0, 0.0),
        (5, None, 3.0, 4.0, 9.0, 9.0, 0.3, 0.0),
        (6, None, 6.0, 8.0, 1.0, 1.0, 0.9, 0.0),
    ]
    df = _frame(spark, data)
    out = {r["row_id"]: r for r in engineer_features(df, bucket_width=2.0).collect()}
    # sender 10: sequence 0,1,2 across a bucket boundary
    assert [out[i]["sender_sequence"] for i in (1, 2, 3)] == [0, 1, 2]
    assert out[2]["acceleration_x"] == 1.0 and out[3]["acceleration_x"] == 2.0
    assert out[2]["position_change_magnitude"] == 5.0 and out[3]["position_change_magnitude"] == 0.0
    pcs = [0.0, 5.0, 0.0]
    mean = sum(pcs) / 3
    std = math.sqrt(sum((x - mean) ** 2 for x in pcs) / 2)
    assert abs(out[1]["position_consistency"] - std) < 1e-12
    assert out[1]["inter_arrival_time"] == 1.0 and out[1]["night_hours"] == 0
    # single-message sender: diffs and stds 0
    assert out[4]["acceleration_x"] == 0.0 and out[4]["speed_consistency"] == 0.0
    # missing sender: sequence/diffs/stds 0, row-wise features as usual
    for i in (5, 6):
        assert out[i]["sender_sequence"] == 0 and out[i]["hour"] == 0
        assert out[i]["acceleration_x"] == 0.0 and out[i]["position_consistency"] == 0.0
        assert out[i]["inter_arrival_time"] == 1.0
    assert out[5]["speed_magnitude"] == 5.0 and out[6]["speed_magnitude"] == 10.0


def test_lag_next_to_missing_value(spark):
    data = [(1, 7, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
            (2, 7, None, 0.0, 0.0, 0.0, 0.0, 0.0),
            (3, 7, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    for width in (1.0, 10.0):
        out = {r["row_id"]: r for r in engineer_features(_frame(spark, data), bucket_width=width).collect()}
        assert out[2]["acceleration_x"] == 0.0 and out[3]["acceleration_x"] == 0.0
        # std over the speeds {1, 4}; the missing speed is skipped, then filled with 0
        assert abs(out[1]["speed_consistency"] - math.sqrt(4.5)) < 1e-12
        assert out[2]["speed_magnitude"] == 0.0


def test_fixed_mode(spark):
    m = load_messages(spark, SF_SMALL)
    f = engineer_features(m, fixed=True, bucket_width=11.0)
    assert "inter_arrival_seconds" in f.columns
    bad = f.where((F.col("hour") >= 22) & (F.col("night_hours") != 1)).count()
    assert bad == 0


@pytest.mark.parametrize("most", [1000, 3])
def test_hot_sender_is_split_and_exact(spark, monkeypatch, most):
    """Parts hold about the bound however large a sender is: with three parts a step the hot sender is cut again and again."""
    from beaconflow.operators import features
    from conftest import SF_MID
    monkeypatch.setattr(features, "MOST_PARTS", most)
    m = load_messages(spark, SF_MID)
    # one sender owns a third of all messages, some have none, and one clock is far off: order keys are not spread evenly
    hot = m.withColumn("senderpseudo", F.when(F.col("row_id") % 11 == 0, F.lit(None)).when(F.pmod("row_id", F.lit(3)) == 0, F.lit(999_999))
                       .otherwise(F.col("senderpseudo")))
    hot = hot.withColumn("row_id", F.when(F.col("row_id") % 1000 == 3, F.col("row_id") - 10 ** 9).otherwise(F.col("row_id")))
    per_task = 600
    fast = engineer_features(hot, rows_per_part=per_task)
    assert rows(fast, COLS) == rows(engineer_features_simple(hot), COLS)
    parts = features.with_parts(hot, "senderpseudo", "row_id", per_task).where("senderpseudo is not null").groupBy("senderpseudo", "_b").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).orderBy("_b").collect()
    mine = [p for p in parts if p.senderpseudo == 999_999]
    assert max(p.n for p in parts) <= 1.1 * per_task and sum(p.n for p in mine) > 3000 and len(mine) > 5
    assert all(p.hi < q.lo for p, q in zip(mine, mine[1:]))
    assert features.with_parts(m, "senderpseudo", "row_id", 10 ** 6) is None
    assert rows(engineer_features(hot), COLS) == rows(engineer_features_simple(hot), COLS)


def test_equal_order_keys_end_the_cutting(spark):
    from beaconflow.operators.features import with_parts
    df = spark.createDataFrame([(1, 5.0)] * 50 + [(1, 6.0)] * 3 + [(2, None)] * 40, "senderpseudo int, row_id double")
    got = {(r.senderpseudo, r._b): r["count"] for r in with_parts(df, "senderpseudo", "row_id", 10).groupBy("senderpseudo", "_b").count().collect()}
    assert sorted(got.values()) == [3, 40, 50]


def test_no_large_sender_needs_one_shuffle_and_no_join(spark):
    plan = engineer_features(load_messages(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
