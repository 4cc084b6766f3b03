from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column expression on a single text value."""
    from pyspark.sql import functions as F

    def evaluate(fn, *values):
        names = [f"v{i}" for i in range(len(values))]
        schema = ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([tuple(values)], schema)
        return df.select(fn(*[F.col(n) for n in names]).alias("out")).first()["out"]

    return evaluate
