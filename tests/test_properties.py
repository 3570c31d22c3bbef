"""Property-based checks (hypothesis) of the two most intricate operators."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from beaconflow.operators.features import engineer_features
from beaconflow.operators.profile import exact_quantiles
from beaconflow.schema import ENGINEERED_17
from conftest import rows
from simple_features import engineer_features_simple

COLS = ["row_id", "senderpseudo"] + ENGINEERED_17
SCHEMA = ("row_id long, senderpseudo long, spdx double, spdy double, posx double, posy double, "
          "hedy double, hedx_n double")

value = st.one_of(st.none(), st.floats(min_value=-50, max_value=50, allow_nan=False).map(lambda v: round(v, 3)))
message = st.tuples(st.one_of(st.none(), st.integers(0, 3)), value, value, value, value, value, value)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(msgs=st.lists(message, min_size=1, max_size=40), width=st.sampled_from([1.0, 2.0, 3.0, 7.0, 1000.0]))
def test_bucketed_features_equal_whole_sender_window(spark, msgs, width):
    data = [(i, *m) for i, m in enumerate(msgs)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(engineer_features(df, bucket_width=width), COLS) == rows(engineer_features_simple(df), COLS)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(vals=st.lists(st.integers(-20, 20), min_size=1, max_size=60))
def test_exact_quantiles_equal_numpy(spark, vals):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["v"], [0.1, 0.5, 0.9]).collect()}
    for p in (0.1, 0.5, 0.9):
        assert abs(got[p] - np.percentile(vals, p * 100)) < 1e-9
