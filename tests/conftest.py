import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stockcast.session import build_session  # noqa: E402
from suite.base import ensure_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    ensure_scratch(session)
    yield session
    session.stop()


@pytest.fixture
def festivals(spark):
    from stockcast.sources.festivals import festival_dim

    return festival_dim(spark)


@pytest.fixture
def series(spark):
    """Daily series from lists of units, one per category, starting on a day."""
    def build(start="2024-01-01", **units):
        first = dt.date.fromisoformat(start)
        rows = [(k, first + dt.timedelta(days=i), int(u)) for k, us in units.items() for i, u in enumerate(us)]
        return spark.createDataFrame(rows, "category string, date date, units_sold bigint")

    return build


@pytest.fixture
def forecast(spark):
    """Forecast rows from lists of (mean, low, high, score), one list per category."""
    def build(start="2024-01-01", **points):
        first = dt.date.fromisoformat(start)
        rows = [
            (k, i + 1, first + dt.timedelta(days=i), float(m), float(lo), float(hi), float(s))
            for k, ps in points.items()
            for i, (m, lo, hi, s) in enumerate(ps)
        ]
        return spark.createDataFrame(
            rows,
            "category string, day_index int, date date, predicted_mean double, lower_95 double, upper_95 double, festival_score double",
        )

    return build
