import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quarrystone.runtime import ship
    from quarrystone.session import local_session

    s = local_session("4", "tests", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL
