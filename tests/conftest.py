import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lensframe.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", cores=4, **{"spark__sql__shuffle__partitions": "4"})


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
