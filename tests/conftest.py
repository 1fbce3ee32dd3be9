import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quillmesh.session import local_session, ship

    session = ship(local_session(cores=4, name="tests"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
