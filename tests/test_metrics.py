import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from navloom.operators.positions import top_k, value_positions
from navloom.plans import nightly, peers, quality, returns, risk
from navloom.sources import benchmark
from tests.conftest import growing, rows_of, series

AS_OF = "2020-12-31"
END = dt.date(2020, 12, 31)
PROXIES = "category STRING, proxy_scheme_code STRING, proxy_name STRING, note STRING"


def ending(days, daily=0.001, end=END, **kw):
    return series(days, daily, start=end - dt.timedelta(days=days - 1), **kw)


# --- point-to-point returns -------------------------------------------------------

@pytest.fixture(scope="module")
def point_returns(nav_of):
    day = dt.timedelta(days=1)
    nav = nav_of({
        "steady": growing(365 * 6, 10.0, start=END - 365 * 6 * day + day),
        "edge": [(END - 379 * day, 50.0), (END - 378 * day, 80.0), (END, 100.0)],
        "late": [(END - 379 * day, 50.0), (END, 100.0)],
        "zero": [(END - 30 * day, 0.0), (END, 100.0)],
        "jump": [(END - 200 * day, 100.0), (END - 182 * day, 101.0), (END - 91 * day, 160.0), (END - 30 * day, 161.0), (END, 170.0)],
    })
    return rows_of(returns.scheme_returns(nav), "scheme_code", "period")


def test_three_years_and_more_are_annualised(point_returns):
    assert point_returns["steady", "1Y"]["ret"] == pytest.approx(10.0, abs=0.02)
    assert point_returns["steady", "5Y"]["ret"] == pytest.approx(10.0, abs=0.02)
    assert ("steady", "10Y") not in point_returns


def test_anchor_may_be_two_weeks_older(point_returns):
    # 13 days before the target counts, 14 days does not
    assert point_returns["edge", "1Y"]["ret"] == 25.0
    assert ("late", "1Y") not in point_returns


def test_zero_anchor_gives_no_row(point_returns):
    assert ("zero", "1M") not in point_returns


def test_jump_inside_the_period_gives_no_row(point_returns):
    # the jump lands on the 3M anchor itself: 3M starts after it, 6M spans it
    assert ("jump", "6M") not in point_returns
    assert point_returns["jump", "3M"]["ret"] == 6.25
    assert point_returns["jump", "1M"]["as_of_date"] == END


# --- risk ---------------------------------------------------------------------------

def wave(n, scale, end=END, base=0.0004):
    steps = base + scale * np.sin(np.arange(n) * 1.7)
    navs = 100 * np.cumprod(np.r_[1, 1 + steps[1:]])
    return [(end - dt.timedelta(days=n - 1 - i), float(v)) for i, v in enumerate(navs)]


@pytest.fixture(scope="module")
def risk_rows(spark, nav_of):
    nav = nav_of({"clean": ending(201), "jump": ending(201, jump_at=100, jump=0.5), "mild": ending(201, jump_at=100, jump=0.30),
                  "just_over": ending(201, jump_at=100, jump=0.45), "few": ending(145), "edge150": ending(151), "edge149": ending(150),
                  "wave": wave(300, 0.01), "bench": wave(320, 0.005), "sparse": wave(300, 0.01)[::2], "not_done": ending(201),
                  "zero": [(d, 0.0 if i == 50 else v) for i, (d, v) in enumerate(ending(201))]})
    codes = ["clean", "jump", "mild", "just_over", "few", "edge150", "edge149", "wave", "bench", "sparse", "zero"]
    master = spark.createDataFrame([(c, "cat", "done") for c in codes] + [("not_done", "cat", None)],
                                   "scheme_code STRING, category STRING, backfill_status STRING")
    proxies = spark.createDataFrame([("cat", "bench", "B", None)], PROXIES)
    return rows_of(risk.scheme_risk(nav, master, proxies, AS_OF), "scheme_code", "period")


def test_clean_window_has_metrics(risk_rows):
    assert risk_rows["clean", "1Y"]["stdev"] == 0.0 and risk_rows["clean", "1Y"]["max_drawdown"] == 0.0


def test_jump_withholds_the_window(risk_rows):
    assert ("jump", "1Y") not in risk_rows and ("just_over", "1Y") not in risk_rows and ("zero", "1Y") not in risk_rows
    assert ("mild", "1Y") in risk_rows


def test_150_steps_are_needed(risk_rows):
    assert ("few", "1Y") not in risk_rows and ("edge149", "1Y") not in risk_rows and ("edge150", "1Y") in risk_rows


def test_only_backfilled_schemes(risk_rows):
    assert ("not_done", "1Y") not in risk_rows


def test_values_match_numpy(risk_rows):
    navs = np.array([v for _, v in wave(300, 0.01)])
    bench = np.array([v for _, v in wave(320, 0.005)])
    r, n = navs[1:] / navs[:-1] - 1, navs[1:]
    b_all = bench[1:] / bench[:-1] - 1
    b, bn = b_all[-299:], bench[1:]
    stdev = np.std(r, ddof=1) * np.sqrt(252) * 100
    annual = ((n[-1] / n[0]) ** (252 / len(r)) - 1) * 100
    bench_annual = ((bn[-1] / bn[0]) ** (252 / len(bn)) - 1) * 100
    beta = np.cov(r, b, ddof=1)[0, 1] / np.var(b, ddof=1)
    row = risk_rows["wave", "1Y"]
    assert row["stdev"] == pytest.approx(stdev, abs=0.0051)
    assert row["sharpe"] == pytest.approx((annual - 6.5) / stdev, abs=0.0051)
    assert row["max_drawdown"] == pytest.approx(((n / np.maximum.accumulate(n)) - 1).min() * 100, abs=0.0051)
    assert row["beta"] == pytest.approx(beta, abs=0.0051)
    assert row["alpha"] == pytest.approx(annual - (6.5 + beta * (bench_annual - 6.5)), abs=0.0051)


def test_proxy_has_no_beta_of_its_own(risk_rows):
    assert risk_rows["bench", "1Y"]["beta"] is None and risk_rows["bench", "1Y"]["stdev"] is not None


# --- quality ------------------------------------------------------------------------

def test_quality_flags(spark, nav_of):
    day = dt.timedelta(days=1)
    nav = nav_of({
        "healthy": ending(400), "stale": ending(100, end=END - 46 * day), "edge": ending(100, end=END - 45 * day),
        "jump": ending(300, jump_at=200), "old_jump": ending(600, jump_at=100),
        # the step into the one-year slice is not looked at
        "before": [(END - 366 * day, 100.0), (END - 365 * day, 200.0), (END, 201.0)],
        "both": ending(300, end=END - 60 * day, jump_at=250), "exact": [(END - day, 100.0), (END, 140.0)]})
    names = ["healthy", "stale", "edge", "jump", "old_jump", "before", "both", "exact", "nothing"]
    master = spark.createDataFrame([(n,) for n in names], "scheme_code STRING")
    flags = {k: v["data_quality"] for k, v in rows_of(quality.quality_flags(master, nav, AS_OF), "scheme_code").items()}
    assert flags == {"healthy": None, "stale": "stale", "edge": None, "jump": "discontinuity", "old_jump": None, "before": None,
                     "both": "stale", "exact": None, "nothing": "stale"}


# --- peers --------------------------------------------------------------------------

def _peer_tables(spark, values, flagged=()):
    rets = spark.createDataFrame([(f"s{i}", "1Y", float(v), END) for i, v in enumerate(values)],
                                 "scheme_code STRING, period STRING, ret DOUBLE, as_of_date DATE")
    master = spark.createDataFrame([(f"s{i}", "cat", "stale" if i in flagged else None) for i in range(len(values))],
                                   "scheme_code STRING, category STRING, data_quality STRING")
    return rets, master


def test_rankings_with_ties(spark):
    rets, master = _peer_tables(spark, [10, 20, 20, 5, 99], flagged=(4,))
    rows = rows_of(peers.rankings(rets, master), "scheme_code")
    assert {k: (v["rank_in_category"], v["category_size"], v["percentile"]) for k, v in rows.items()} == {
        "s0": (3, 4, 33.0), "s1": (1, 4, 67.0), "s2": (1, 4, 67.0), "s3": (4, 4, 0.0)}


def test_only_fund_of_a_category(spark):
    row = peers.rankings(*_peer_tables(spark, [7.5])).collect()[0]
    assert (row.rank_in_category, row.category_size, row.percentile) == (1, 1, 0.0)


def test_category_statistics(spark):
    stats = peers.category_stats(*_peer_tables(spark, [-3.25, 4, 1, 10.5, 99], flagged=(4,))).collect()[0]
    assert (stats.avg_return, stats.median_return, stats.scheme_count) == (3.06, 2.5, 4)


def test_positions_match_plain_windows(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(0, 30, 3000), 2)
    df = spark.createDataFrame([("hot" if i % 3 else "cold", float(v)) for i, v in enumerate(values)], "g STRING, v DOUBLE")
    got = {(r.g, r.v): (r.below, r.n, r.total) for r in value_positions(df, ["g"], "v").collect()}
    for g in ("hot", "cold"):
        mine = np.array([v for i, v in enumerate(values) if (i % 3 != 0) == (g == "hot")])
        for v in set(mine):
            assert got[g, float(v)] == ((mine < v).sum(), (mine == v).sum(), len(mine))


def test_percentile_labels(spark):
    df = spark.createDataFrame([(100.0,), (67.0,), (50.0,), (10.0,), (None,)], "p DOUBLE")
    rows = df.select(peers.top_share_label(F.col("p")).alias("t"), peers.percentile_band(F.col("p")).alias("b")).collect()
    assert [r.t for r in rows][:4] == [1, 33, 50, 90]
    assert [r.b for r in rows] == ["top", "top", "middle", "bottom", None]


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = top_k(df, ["g"], [F.desc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- nightly -------------------------------------------------------------------------

def test_rebuild_writes_every_table_and_repeats(spark, nav_of, tmp_path):
    nav = nav_of({"a": ending(400, 0.001), "b": ending(400, 0.002), "dead": ending(200, end=END - dt.timedelta(days=90))})
    master = spark.createDataFrame([(c, "n", "Equity Scheme - Flexi Cap Fund", "done", True) for c in ("a", "b", "dead")],
                                   "scheme_code STRING, name STRING, category STRING, backfill_status STRING, is_active BOOLEAN")
    first = nightly.rebuild(spark, nav, master, benchmark.benchmark_proxies(spark), AS_OF, str(tmp_path))
    counts = {name: table.count() for name, table in first.items()}
    again = nightly.rebuild(spark, nav, master, benchmark.benchmark_proxies(spark), AS_OF, str(tmp_path))
    assert counts == {name: table.count() for name, table in again.items()}
    assert counts["scheme_master"] == 3 and counts["category_stats"] == 4
    ranked = rows_of(again["rankings"].filter("period = '1Y'"), "scheme_code")
    assert set(ranked) == {"a", "b"} and ranked["b"]["rank_in_category"] == 1


def test_benchmark_dimension(spark):
    table = benchmark.benchmark_proxies(spark)
    assert table.count() == 21 and table.select("proxy_scheme_code").distinct().count() == 4
    stale = spark.createDataFrame([("Equity Scheme - ELSS", "1", "old", None), ("Own", "2", "kept", None)], table.schema)
    seeded = rows_of(benchmark.seed(stale, spark), "category")
    assert len(seeded) == 22 and seeded["Equity Scheme - ELSS"]["proxy_scheme_code"] == "147625" and seeded["Own"]["proxy_name"] == "kept"
