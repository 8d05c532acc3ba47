import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
EVENTS = tempfile.mkdtemp(prefix="facsimile-events-")     # the session's event log: the plans of all its jobs


@pytest.fixture(scope="session")
def spark():
    from facsimile.session import get_session
    s = get_session("local[4]", shuffle_partitions=4, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{EVENTS}", "spark.eventLog.compress": "false",
        "spark.eventLog.rolling.enabled": "false", "spark.eventLog.buffer.kb": "1k"})
    yield s


@pytest.fixture(scope="session")
def tables(spark):
    def load(name, sf=SF001):
        return spark.read.parquet(f"{sf}/{name}.parquet")
    return load
