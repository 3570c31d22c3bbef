"""Column sets, label maps and the message schema.

The lists and maps under "Fixed values" must equal the reference's for
results to line up; they are stated as-is, in the reference's order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (taken unchanged from the reference's behaviour)
# ---------------------------------------------------------------------------

# 29-column message record, in the record's text order.
MESSAGE_29 = [
    "type", "sendtime", "sender", "senderpseudo", "messageid",
    "posx", "posy", "posz", "posx_n", "posy_n", "posz_n",
    "spdx", "spdy", "spdz", "spdx_n", "spdy_n", "spdz_n",
    "aclx", "acly", "aclz", "aclx_n", "acly_n", "aclz_n",
    "hedx", "hedy", "hedz", "hedx_n", "hedy_n", "hedz_n",
]

# 15 selected features.
FEATURES_15 = [
    "sendtime", "senderpseudo", "posx", "posy", "posx_n", "spdx", "spdy",
    "spdx_n", "spdy_n", "aclx", "acly", "hedx", "hedy", "hedx_n", "hedy_n",
]

# 8 base features for sequence engineering.
FEATURES_8 = ["senderpseudo", "posx", "posy", "posx_n", "spdx", "spdy", "hedy", "hedx_n"]

# 17 engineered sequence features, in output order.
ENGINEERED_17 = [
    "sender_sequence", "inter_arrival_time", "speed_magnitude",
    "acceleration_x", "acceleration_y", "acceleration_magnitude",
    "position_change_x", "position_change_y", "position_change_magnitude",
    "heading_change", "heading_magnitude", "speed_consistency",
    "position_consistency", "hour", "night_hours",
    "speed_position_interaction", "inter_arrival_speed_ratio",
]

# Raw attack id (0-19) -> class group (0-5).
CLASS_GROUP = {
    0: 0,
    1: 1, 2: 1, 3: 1, 4: 1,
    5: 2, 6: 2, 7: 2, 10: 2, 11: 2, 12: 2,
    8: 3, 9: 3, 17: 3,
    13: 4,
    14: 5, 15: 5, 16: 5, 18: 5, 19: 5,
}

# Class group -> display name.
CLASS_NAMES = {
    0: "Normal",
    1: "Position-related faults",
    2: "DoS-related attacks",
    3: "Data/Message manipulation attacks",
    4: "Eventual Stop",
    5: "Speed-related faults",
}

# Classes kept by the feature-search run.
SEARCH_CLASSES = [0, 1, 3, 4]

# Column positions kept by the position-based projection.
POSITION_SET = [1, 3, 7, 8, 12, 13, 14]

# Generalisation-gap bands (upper bounds, exclusive) and their verdicts.
GAP_BANDS = [(0.02, "excellent"), (0.05, "good"), (0.10, "moderate")]
GAP_OTHERWISE = "severe"

# Hyper-parameter vector order, start point and search bounds (narrow / wide).
PARAM_NAMES = [
    "max_depth", "learning_rate", "n_estimators", "subsample", "colsample_bytree",
    "gamma", "min_child_weight", "reg_alpha", "reg_lambda",
]
PARAM_START = [8, 0.07, 500, 0.9, 0.9, 0.0, 1.0, 0.0, 1.0]
PARAM_BOUNDS_NARROW = [(6, 12), (0.03, 0.15), (300, 700), (0.8, 1.0), (0.8, 1.0),
                       (0, 2), (1, 5), (0, 5), (0.5, 3)]
PARAM_BOUNDS_WIDE = [(3, 10), (0.01, 0.3), (100, 1000), (0.6, 1.0), (0.6, 1.0),
                     (0, 5), (1, 10), (0, 10), (0, 10)]
# Integer-valued positions in the parameter vector.
PARAM_INTEGER_POSITIONS = [0, 2, 6]

# ---------------------------------------------------------------------------
# Derived
# ---------------------------------------------------------------------------

NUMERIC_13 = [c for c in FEATURES_15 if c not in ("sendtime", "senderpseudo")]
ENGINEERED_25 = FEATURES_8 + ENGINEERED_17

_INT_COLS = {"type"}
_LONG_COLS = {"sender", "senderpseudo", "messageid"}


def _field(name: str) -> T.StructField:
    if name in _INT_COLS:
        return T.StructField(name, T.IntegerType(), True)
    if name in _LONG_COLS:
        return T.StructField(name, T.LongType(), True)
    return T.StructField(name, T.DoubleType(), True)


MESSAGE_SCHEMA = T.StructType([_field(c) for c in MESSAGE_29])
LABELLED_SCHEMA = T.StructType(MESSAGE_SCHEMA.fields + [T.StructField("class", T.IntegerType(), True)])
MESSAGE_DDL = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MESSAGE_SCHEMA.fields)
