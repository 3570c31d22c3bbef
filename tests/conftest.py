import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from beaconflow.session import get_session
    s = get_session(app="beaconflow-tests", cores="4", shuffle_partitions=8)
    yield s


def rows(df, cols=None, nd=6):
    """Sorted, rounded row tuples for order-insensitive comparison."""
    cols = cols or df.columns
    out = []
    for r in df.select(*cols).collect():
        out.append(tuple(round(v, nd) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)
