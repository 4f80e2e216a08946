import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepool.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions=4, spark__driver__memory="6g", spark__ui__showConsoleProgress="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    """Build canonical events from (user, item, event, second) tuples."""

    def build(rows):
        df = spark.createDataFrame([(u, i, e, int(s)) for u, i, e, s in rows], "user_id long, item_id long, event string, s long")
        return df.selectExpr("user_id", "item_id", "event", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts")

    return build


def rows(df):
    return sorted(tuple(r) for r in df.collect())
