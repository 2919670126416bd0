import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from qalytics.session import local_session

    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as sorted tuples (optionally of the given columns)."""
    d = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in d.collect()), key=lambda t: tuple((x is not None, x) for x in t))
