"""Counter pieces of phrase mining: what is packed comes back, in fewer bytes than places in full."""

import numpy as np

from beaconflow.llm.phrases import pack_counts, unpack_counts
from beaconflow.llm.sums import pack


def test_counters_pack_by_gaps():
    rng = np.random.default_rng(3)
    for most in (1, 50, 4000, 40000):
        places = np.unique(rng.integers(0, 1 << 16, most))
        n = np.minimum(rng.geometric(0.7, len(places)), 30)
        back, times = unpack_counts(pack_counts(places, n))
        assert (back == places).all() and (times == n).all()
        if most >= 4000:
            full = pack(np.append(places.astype(np.uint16).view(np.uint8), n.astype(np.uint8)))
            assert len(pack_counts(places, n)) < 0.9 * len(full)
