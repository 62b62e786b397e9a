import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridmeter.session import checkpoint_dir, get_spark

    s = get_spark("local[4]", **{"spark.sql.shuffle.partitions": "8"})
    checkpoint_dir(s)  # tests only: a local folder, since none is configured
    yield s
    s.stop()


SF = os.environ.get("GRIDMETER_TEST_SF", "/root/testdata/sf0.01")
