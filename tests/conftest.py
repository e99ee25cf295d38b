import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from navloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("scratch")
    session = build_session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.checkpoint.dir": str(scratch),
                                              "spark.sql.warehouse.dir": str(scratch / "warehouse")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def nav_of(spark):
    """A price table from {scheme: [(date, nav)]}."""
    def make(series):
        rows = [(code, day, float(nav)) for code, points in series.items() for day, nav in points]
        return spark.createDataFrame(rows, "scheme_code STRING, date DATE, nav DOUBLE")
    return make


def series(days, daily=0.0, start=dt.date(2015, 1, 1), nav=100.0, jump_at=None, jump=0.5):
    """One price per day, compounding, with one optional jump."""
    points = []
    for i in range(days):
        points.append((start + dt.timedelta(days=i), nav))
        nav *= 1 + (jump if i == jump_at else daily)
    return points


def growing(days, annual_pct, **kw):
    return series(days, (1 + annual_pct / 100) ** (1 / 365) - 1, **kw)


def rows_of(df, *key):
    """{key: row as dict} of a small result."""
    out = {}
    for row in df.collect():
        k = tuple(row[c] for c in key)
        out[k if len(key) > 1 else k[0]] = row.asDict()
    return out
