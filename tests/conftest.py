import sys

import pytest

sys.path.insert(0, "/root/repo")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    s = local_session(8, partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from tidemark.plans.staging import drop_staged

    drop_staged(s)
    s.stop()
