import os

import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from vellumspark.session import local_session

    s = local_session(cores="4", shuffle_partitions=4, app="vellumspark-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
