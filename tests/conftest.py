import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session

    spark = get_session("local[4]", "tessera-tests", shuffle_partitions=4, driver_memory="4g")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-test-ckpt-"))
    yield spark


@pytest.fixture
def tmp_root():
    return tempfile.mkdtemp(prefix="tessera-test-")


SF_SMALL = "/root/testdata/sf0.001"
