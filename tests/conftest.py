import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tailorspark.session import get_session

    s = get_session("local[4]", **{"spark.sql.shuffle.partitions": "4"})
    yield s


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
