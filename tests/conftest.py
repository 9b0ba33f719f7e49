import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from callgauge.session import checkpoint_dir, get_spark
    shared = tmp_path_factory.mktemp("shared")
    s = get_spark("local[4]", 8, app_name="callgauge-tests",
                  conf={"spark.checkpoint.dir": str(shared / "scratch"), "spark.sql.warehouse.dir": str(shared / "warehouse")})
    checkpoint_dir(s)
    yield s
    s.stop()
