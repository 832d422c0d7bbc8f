import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chartlore.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture
def entries(spark):
    """Builds entries from (chart, date, rank, title, artist) tuples."""

    def build(rows):
        frame = spark.createDataFrame(rows, "chart string, date string, rank int, title string, artist string")
        return frame.withColumn("date", frame.date.cast("date"))

    return build
