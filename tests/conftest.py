import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from mixtura.session import build, ship

    shared = "file://" + str(tmp_path_factory.mktemp("shared"))
    session = build("local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()
