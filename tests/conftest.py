import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from relstream.session import build_session

    folder = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests", cores=4,
        conf={"spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(folder / "checkpoints")},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
