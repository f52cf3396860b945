import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[k]) for k in (1, 0)]

from galeframe.session import build_session  # noqa: E402
from series_times import T0  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Builds (site, date, <value>) frames from {site: {hour: value}}."""

    def build(data, value="power"):
        rows = [
            (site, T0 + dt.timedelta(hours=h), None if v is None else float(v))
            for site, points in data.items()
            for h, v in points.items()
        ]
        return spark.createDataFrame(rows, f"site int, date timestamp_ntz, {value} double")

    return build
