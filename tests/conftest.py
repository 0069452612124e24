import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from logweave.session import local_session
    s = local_session("*", 8)
    yield s


def rows(df, *cols):
    """Collected rows as tuples of the given columns, sorted."""
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
