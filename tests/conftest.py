import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import connect, make_spark  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return make_spark(8)


@pytest.fixture(scope="session")
def con():
    return connect(SF_DIR)


@pytest.fixture
def frame(spark):
    """``frame(schema, *rows)``: a small literal table."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


class Tables(dict):
    """A hand-made store: table name -> DataFrame."""

    def __init__(self, spark, **frames):
        super().__init__(**frames)
        self.spark = spark


@pytest.fixture
def store(spark):
    return lambda **frames: Tables(spark, **frames)


def rows_of(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
