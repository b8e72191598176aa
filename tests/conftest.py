import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from snapfeed.session import build_session, shared_dir

    spark = build_session("local[4]", 4, app_name="snapfeed-tests")
    # the session's spark.checkpoint.dir wins; a scratch folder only when it is unset
    shared_dir(spark, fallback=tempfile.mkdtemp(prefix="snapfeed-test-") + "/ckpt")
    yield spark
    spark.stop()


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
