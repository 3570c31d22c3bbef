"""Senders of a bucket are advanced together, and in parts as in one go."""

import numpy as np
import pandas as pd

from beaconflow.streaming import features as T


def test_parts_continue_the_state_of_many_senders():
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"_s": rng.integers(0, 7, 200), "row_id": np.arange(200), **{c: rng.normal(size=200) for c in T._BASE}})
    rows.loc[rng.random(200) < 0.1, "spdx"] = np.nan
    nothing, order = T._frame(T._COUNTERS, None), ["_s", "row_id"]
    whole, _ = T._sequence(rows.sort_values(order), nothing)
    known, parts = nothing, []
    for i in range(0, 200, 30):
        out, known = T._sequence(rows[i:i + 30].sort_values(order), known)
        known = T._frame(T._COUNTERS, [known[c].tolist() for c in T._COUNTERS])  # as it comes back from the state
        parts.append(out)
    pd.testing.assert_frame_equal(pd.concat(parts).sort_values("row_id", ignore_index=True), whole.sort_values("row_id", ignore_index=True))
    for s, own in whole.groupby("senderpseudo"):
        mine = rows[rows["_s"] == s]
        speed = np.sqrt(mine["spdx"] ** 2 + mine["spdy"] ** 2)
        assert abs(own["speed_consistency"].iloc[-1] - speed.std()) < 1e-9 and list(own["sender_sequence"]) == list(range(len(mine)))
    assert len(T._sequence(rows[:0], known)[0]) == 0
