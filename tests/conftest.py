import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docwarden.session import local_session


def pytest_collection_modifyitems(items):
    # Functions of the tests run in tasks too.
    for module in {i.module for i in items}:
        cloudpickle.register_pickle_by_value(module)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, memory="6g")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()
