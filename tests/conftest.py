import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from txnlake.session import build_session
    s = build_session("local[4]", shuffle_partitions=8)
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="txnlake-test-ckpt-"))
    yield s
    s.stop()


def rows(df, order=None):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
