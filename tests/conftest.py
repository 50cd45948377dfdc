import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(df, *columns):
    """Rows as tuples of the named columns, sorted."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
