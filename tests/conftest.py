import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from newsweave.session import get_spark
    s = get_spark(app="newsweave-tests", master="local[4]", shuffle_partitions=8,
                  checkpoint_dir=tempfile.mkdtemp(prefix="nw-test-ckpt-", dir="/tmp"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_out():
    return tempfile.mkdtemp(prefix="nw-test-out-", dir="/tmp")
