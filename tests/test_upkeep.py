import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.plans import returns, risk, upkeep
from navloom.sources import benchmark, prices, versions

END = dt.date(2026, 8, 25)
CATEGORY, PROXY = K.BENCHMARK_PROXIES[0][0], K.BENCHMARK_PROXIES[0][1]


def market(seed, days=1400):
    """Schemes with gaps, a jump, a zero, a late start and an early end, beside the benchmark of their category."""
    rng = random.Random(seed)
    out = {}
    for code in (PROXY, "plain", "gaps", "jumps", "zero", "young", "old", "other"):
        nav, points = 100.0, []
        for i in range(days):
            nav *= 1 + rng.gauss(0.0004, 0.011)
            if code == "jumps" and i == 900:
                nav *= 1.6
            day = END - dt.timedelta(days - 1 - i)
            if (code == "gaps" and (i % 7 in (5, 6) or 400 < i < 480)) or (code == "young" and i < 800) or (code == "old" and i > 1100):
                continue
            points.append((day, 0.0 if code == "zero" and i == 1200 else round(nav, 4)))
        out[code] = points
    return out


@pytest.fixture(scope="module")
def tables(spark):
    master = spark.createDataFrame([(c, CATEGORY if c != "other" else None, "done") for c in market(0)] + [("pending", CATEGORY, None)],
                                   "scheme_code STRING, category STRING, backfill_status STRING")
    return master, benchmark.benchmark_proxies(spark)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def equal(spark, store, state, master, proxies, as_of):
    nav = prices.read_prices(spark, store).cache()
    found = rows(upkeep.scheme_returns(spark, state)), rows(upkeep.scheme_risk(spark, state))
    assert found[0] == rows(returns.scheme_returns(nav))
    assert found[1] == rows(risk.scheme_risk(nav, master, proxies, as_of))
    assert found[0] and found[1]


def test_tables_after_each_batch_equal_a_rebuild(spark, nav_of, tables, tmp_path):
    master, proxies = tables
    store, state, as_of = str(tmp_path / "store"), str(tmp_path / "state"), str(END)
    nav = nav_of(market(1))
    cut = END - dt.timedelta(40)
    upkeep.ingest(spark, store, state, nav.filter(F.col("date") < F.lit(cut)), master, proxies, as_of)
    equal(spark, store, state, master, proxies, as_of)
    # the newest days, corrections of a few schemes far back and of the benchmark, and a price that makes and one that heals a jump
    changes = [nav.filter(F.col("date") >= F.lit(cut)),
               nav_of({"plain": [(END - dt.timedelta(700), 77.0), (END - dt.timedelta(1400), 3.0)], "gaps": [(END - dt.timedelta(950), 120.0)]}),
               nav_of({PROXY: [(d, round(n * 1.01, 4)) for d, n in market(1)[PROXY][1000:1040]]}),
               nav_of({"plain": [(END - dt.timedelta(300), 400.0)], "zero": [(END - dt.timedelta(199), 90.0)]})]
    for change in changes:
        for _ in range(2 if change is changes[-1] else 1):
            upkeep.ingest(spark, store, state, change, master, proxies, as_of)
        equal(spark, store, state, master, proxies, as_of)


def test_days_leave_a_window(spark, nav_of, tables, tmp_path):
    """A later as_of needs the summaries it has and the days of other edge months."""
    master, proxies = tables
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    nav = nav_of(market(2))
    upkeep.ingest(spark, store, state, nav.filter(F.col("date") < "2026-06-01"), master, proxies, "2026-06-01")
    upkeep.ingest(spark, store, state, nav.filter(F.col("date") >= "2026-06-01"), master, proxies, str(END))
    keys = nav.select("scheme_code", F.lit("2026-08").alias("month")).distinct()
    upkeep.refresh(spark, store, state, keys, master, proxies, str(END))
    equal(spark, store, state, master, proxies, str(END))


def test_only_touched_schemes_and_months_are_made_anew(spark, nav_of, tables, tmp_path, monkeypatch):
    master, proxies = tables
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    upkeep.ingest(spark, store, state, nav_of(market(3)), master, proxies, str(END))
    before = versions.pin(spark, f"{state}/months")
    summed, seen = upkeep.month_summaries, []
    monkeypatch.setattr(upkeep, "month_summaries", lambda nav, *a: seen.extend(nav.select("scheme_code", F.date_format("date", "yyyy-MM")).distinct().collect()) or summed(nav, *a))
    day = END - dt.timedelta(500)
    upkeep.ingest(spark, store, state, nav_of({"plain": [(day, 101.0)]}), master, proxies, str(END))
    after = versions.pin(spark, f"{state}/months")
    assert [tuple(r) for r in seen] == [("plain", f"{day:%Y-%m}")]
    assert {p for p in after.runs if after.runs[p] != before.runs.get(p)} == {f"{day:%Y}"}
    upkeep.refresh(spark, store, state, nav_of({}).select("scheme_code", F.lit("2026-01").alias("month")), master, proxies, str(END))
    assert versions.pin(spark, f"{state}/months") == after


def test_jumps_of_a_month_stay_in_a_hash_aggregate(spark, nav_of):
    days = [(dt.date(2026, 1, d), nav) for d, nav in ((1, 10.0), (2, 20.0), (15, 20.5), (31, 1.0))] + [(dt.date(2026, 2, d), 1.0) for d in (1, 28)]
    links = spark.createDataFrame([], "scheme_code STRING, proxy_scheme_code STRING")
    found = upkeep.month_summaries(nav_of({"a": days}), links, spark.createDataFrame([], "proxy_scheme_code STRING, date DATE, proxy_ret DOUBLE"))
    assert {r.month: r.jumps for r in found.collect()} == {"2026-01": [dt.date(2026, 1, 2), dt.date(2026, 1, 31)], "2026-02": []}
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
