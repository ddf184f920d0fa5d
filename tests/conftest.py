import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("SHOPFRAME_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from shopframe.session import get_session
    s = get_session("local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck():
    from tests.oracle_harness import duck as mk
    return mk(SF_ORACLE)


@pytest.fixture(scope="session")
def t_small(spark):
    from shopframe.sources.fixtures import derive_tables
    return derive_tables(spark, SF_SMALL)
