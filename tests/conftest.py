import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from echofold.session import local_session  # noqa: E402

SF_DIR = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    settings = {"spark.sql.warehouse.dir": str(warehouse), "spark.sql.shuffle.partitions": "2"}
    return local_session("tests", 8, **settings)


@pytest.fixture(scope="session")
def sf_dir():
    if not SF_DIR.exists():
        pytest.skip("the given tables are not here")
    return str(SF_DIR)
