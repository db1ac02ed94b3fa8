import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hourgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        8,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DAY = dt.date(2024, 1, 1)


@pytest.fixture
def prices(spark):
    """Build a price frame from (node, hour, price[, day]) tuples."""

    def build(rows, schema="node string, opr_dt date, opr_hr int, mw decimal(12,4)"):
        from decimal import Decimal

        full = [
            (row[0], row[3] if len(row) > 3 else DAY, row[1], Decimal(str(row[2])))
            for row in rows
        ]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def mapping(spark):
    def build(pairs):
        return spark.createDataFrame(pairs, "pnode_id string, zone string")

    return build
