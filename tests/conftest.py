import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexiframe.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # get_spark keeps spark.checkpoint.dir when the session has one and only
    # fills in a local folder when it is unset.
    s = get_spark("local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="lexiframe-test-")
