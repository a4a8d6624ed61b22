import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from cairn.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def rows():
    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
