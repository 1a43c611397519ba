import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stepweave import build_session  # noqa: E402

T0 = datetime(2150, 1, 15, 12)


def at(hours: float) -> datetime:
    return T0 + timedelta(hours=hours)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def rows_of(df, *order):
    """Rows as tuples, sorted by the given columns (or all)."""
    cols = list(order) or df.columns
    key = [df.columns.index(c) for c in cols]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(r[i]) for i in key))
