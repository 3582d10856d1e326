import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabsmith.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


@pytest.fixture()
def layouts(spark):
    """The same rows in several partitionings, shuffled."""

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return [df.repartition(1), df.repartition(4), df.repartition(17)]

    return make
