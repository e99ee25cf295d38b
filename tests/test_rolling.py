import datetime as dt
import random

import numpy as np
import pytest

from navloom import constants as K
from navloom.plans import rolling
from tests.conftest import growing, rows_of, series

PROXIES = "category STRING, proxy_scheme_code STRING, proxy_name STRING, note STRING"


@pytest.fixture(scope="module")
def returns(nav_of):
    """Rolling returns of all the shapes below, by (scheme, window)."""
    nav = nav_of({
        "steady12": growing(365 * 3, 12.0), "steady10": growing(365 * 6, 10.0), "flat": series(365 * 2),
        "short": growing(200, 10.0), "jumped": growing(365 * 3, 10.0, jump_at=400, jump=0.5),
        "gap": [(dt.date(2020, 1, 1), 100.0), (dt.date(2021, 1, 7), 120.0), (dt.date(2022, 1, 15), 130.0)],
        "zero": [(dt.date(2020, 1, 1), 0.0), (dt.date(2020, 12, 31), 5.0)],
    })
    out = {}
    for r in rolling.rolling_returns(nav).orderBy("date").collect():
        out.setdefault((r.scheme_code, r.window), []).append((r.date, r.ret))
    return out


def test_year_window_of_steady_growth(returns):
    rets = [r for _, r in returns["steady12", "1Y"]]
    assert len(rets) > 500 and np.allclose(rets, 12.0, atol=0.05)


def test_three_years_are_annualised(returns):
    rets = [r for _, r in returns["steady10", "3Y"]]
    assert len(rets) > 300 and np.allclose(rets, 10.0, atol=0.05)


def test_half_year_is_absolute(returns):
    rets = [r for _, r in returns["steady12", "6M"]]
    assert len(rets) > 100 and 5.0 < np.median(rets) < 6.5


def test_flat_price_gives_zero(returns):
    assert np.allclose([r for _, r in returns["flat", "1Y"]], 0.0, atol=1e-6)


def test_short_history_gives_nothing(returns):
    assert ("short", "1Y") not in returns


def test_windows_over_a_jump_are_left_out(returns):
    rets = [r for _, r in returns["jumped", "1Y"]]
    assert len(rets) > 100 and max(rets) < 20 and np.allclose(rets, 10.0, atol=0.1)


def test_end_may_be_a_week_late_and_no_more(returns):
    # 2020-01-01 + 365 days is 2020-12-31, 7 days before the next price; the one
    # after that is 8 days late
    assert [d for d, _ in returns["gap", "1Y"]] == [dt.date(2020, 1, 1)]
    assert returns["gap", "1Y"][0][1] == pytest.approx((1.2 ** (365 / 372) - 1) * 100)


def test_price_must_be_positive(returns):
    assert ("zero", "1Y") not in returns


def test_matches_numpy_search(nav_of):
    rng = np.random.default_rng(5)
    days = np.cumsum(rng.integers(1, 6, 900))
    navs = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 900)))
    navs[300] *= 2.2
    navs = np.round(navs, 4)
    start = dt.date(2010, 1, 1)
    points = [(start + dt.timedelta(days=int(d)), float(v)) for d, v in zip(days, navs)]
    bad = np.cumsum(np.r_[False, np.abs(navs[1:] / navs[:-1] - 1) > 0.4])
    got = {}
    for r in rolling.rolling_returns(nav_of({"x": points}), {"1M": 30, "2Y": 730}).collect():
        got[r.window, r.date] = r.ret
    expected = {}
    for name, width in (("1M", 30), ("2Y", 730)):
        for i in range(900):
            j = int(np.searchsorted(days, days[i] + width))
            if j < 900 and days[j] - days[i] - width <= 7 and bad[i] == bad[j]:
                g = navs[j] / navs[i]
                expected[name, points[i][0]] = ((g ** (365 / (days[j] - days[i])) if width >= 365 else g) - 1) * 100
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)


@pytest.fixture(scope="module")
def stats(spark, nav_of):
    start = dt.date(2015, 1, 1)
    nav = nav_of({"fund": growing(365 * 3, 15.0), "bench": growing(365 * 3, 8.0), "slow": growing(365 * 3, 4.0),
                  "late": growing(365 * 2, 12.0, start=dt.date(2020, 1, 1)),
                  "thin": growing(365 + 29, 10.0, start=start)})
    master = spark.createDataFrame([(c, "cat") for c in ("fund", "slow", "late", "thin", "bench")] , "scheme_code STRING, category STRING")
    proxies = spark.createDataFrame([("cat", "bench", "Bench", None)], PROXIES)
    return rows_of(rolling.rolling_stats(nav, master, proxies), "scheme_code", "window")


def test_beat_rate(stats):
    assert stats["fund", "1Y"]["beat_benchmark_pct"] == 100.0
    assert stats["slow", "1Y"]["beat_benchmark_pct"] == 0.0
    assert stats["late", "1Y"]["beat_benchmark_pct"] is None
    assert stats["bench", "1Y"]["beat_benchmark_pct"] is None


def test_distribution_needs_thirty_windows(stats):
    assert ("thin", "1Y") not in stats and ("thin", "6M") in stats


def test_distribution_values(spark, nav_of):
    # one-month windows over a price that falls, rests and rises
    nav = growing(100, -30.0) + [(d + dt.timedelta(days=100), v * 0.9) for d, v in growing(200, 60.0)]
    df = rolling.rolling_returns(nav_of({"x": nav}), {"1M": 30})
    rets = np.array([r.ret for r in df.collect()])
    master = spark.createDataFrame([("x", "c")], "scheme_code STRING, category STRING")
    row = rolling.rolling_stats(nav_of({"x": nav}), master, spark.createDataFrame([], PROXIES), {"1M": 30}).collect()[0]
    assert row.windows == len(rets)
    for name, value in (("min", rets.min()), ("p25", np.percentile(rets, 25)), ("median", np.median(rets)),
                        ("avg", rets.mean()), ("p75", np.percentile(rets, 75)), ("max", rets.max())):
        assert row[name] == pytest.approx(value, abs=0.0051)
    assert row.pct_negative == pytest.approx((rets < 0).mean() * 100, abs=0.051)
    assert row.pct_above_8 == pytest.approx((rets >= 8).mean() * 100, abs=0.051)


def test_thinned_series_keeps_its_last_point(nav_of):
    nav = nav_of({"x": growing(365 * 5, 10.0)})
    full = sorted(r.date for r in rolling.rolling_returns(nav, {"1Y": 365}).collect())
    thin = sorted(r.date for r in rolling.rolling_points(nav, {"1Y": 365}, max_points=50).collect())
    assert len(thin) <= 51 and thin[-1] == full[-1] and thin[0] == full[0]


def test_window_list():
    assert list(K.ROLLING_DAYS) == ["1M", "3M", "6M", "1Y", "2Y", "3Y", "5Y", "7Y", "10Y"]


def test_thinning_sorts_nothing_again(spark, nav_of):
    """The points keep to the order that their windows had: no shuffle and no sort of rows per window."""
    rng = random.Random(4)
    nav = nav_of({code: [(day, nav * rng.choice((0.5, 1.0, 1.0, 1.0, 1.0))) for day, nav in growing(days, 9)] for code, days in (("a", 900), ("b", 420), ("c", 30))})
    windows = {"1M": 30, "1Y": 365}
    found = rolling.rolling_points(nav, windows, max_points=40)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2  # by date for the jumps, by day number for the windows
    want = set()
    every = rows_of(rolling.rolling_returns(nav, windows), "scheme_code", "window", "date")
    for code in "abc":
        for window in windows:
            days = sorted(k[2] for k in every if k[:2] == (code, window))
            stride = max(1, -(-len(days) // 40))
            want |= {(code, window, d) for i, d in enumerate(days) if i % stride == 0 or i == len(days) - 1}
    assert set(rows_of(found, "scheme_code", "window", "date")) == want
