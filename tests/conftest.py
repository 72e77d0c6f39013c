import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from inkveil.session import get_spark  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    return get_spark("tests", cpus=4, partitions=4, **{"spark.driver.memory": "3g", "spark.checkpoint.dir": str(folder)})


@pytest.fixture(scope="session")
def sf():
    return SF
