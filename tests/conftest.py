"""One small local session for all tests."""

import pytest

from plotwright.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.default.parallelism": "4"})
    yield s
    s.stop()
