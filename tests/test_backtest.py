import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from navloom.functions import tax
from navloom.plans import backtest, projections
from navloom.plans.tax import plan_tax
from tests.conftest import growing, rows_of, series

D = dt.date
PLANS = "plan_id STRING, scheme_code STRING, amount DOUBLE, start_date DATE, last_instalment DATE, freq STRING, marginal_rate DOUBLE"


def plan(pid, scheme, amount, start, last=None, freq="monthly", rate=30.0):
    return pid, scheme, float(amount), start, last, freq, rate


# --- XIRR ----------------------------------------------------------------------------

def test_rates_that_exist_and_rates_that_do_not(spark):
    cases = {"doubled": [(0.0, -250.0), (2.0, 500.0)], "shrunk": [(0.0, -640.0), (3.0, 270.0)], "alone": [(0.5, -80.0)],
             "paid only": [(0.0, -80.0), (0.25, -20.0)], "received only": [(0.0, 5.0), (1.0, 5.0)],
             # Newton's first step from 10% goes below -100%
             "fails": [(0.0, -1000.0), (20.0, 1.0)],
             # a power that underflows to zero is no division error
             "extreme": [(0.0, -1e12), (400.0, 1e-12), (800.0, 1e-300)]}
    df = spark.createDataFrame(list(cases.items()), "k STRING, flows ARRAY<STRUCT<t: DOUBLE, a: DOUBLE>>")
    got = {r.k: r.x for r in df.select("k", backtest.xirr(F.col("flows")).alias("x")).collect()}
    assert got.pop("doubled") == pytest.approx(2 ** 0.5 - 1, abs=1e-6) and got.pop("shrunk") == pytest.approx(-0.25, abs=1e-6)
    assert set(got.values()) == {None}


def test_xirr_solves_the_present_value(spark):
    flows = [(i / 12, -100.0) for i in range(36)] + [(3.0, 4300.0)]
    df = spark.createDataFrame([("a", flows)], "k STRING, flows ARRAY<STRUCT<t: DOUBLE, a: DOUBLE>>")
    rate = df.select(backtest.xirr(F.col("flows")).alias("x")).collect()[0].x
    assert abs(sum(a / (1 + rate) ** t for t, a in flows)) < 0.01


def test_rates_of_a_batch_are_those_of_single_lists(spark):
    def newton(flows, rate=0.1):
        for _ in range(100):
            if rate <= -1:
                return None
            f = sum(a / (1 + rate) ** t for t, a in flows)
            fp = -sum(t * a / (1 + rate) ** (t + 1) for t, a in flows)
            if abs(fp) < 1e-12:
                return None
            rate, before = rate - f / fp, rate
            if abs(rate - before) < 1e-8:
                return round(rate, 6)
        return None

    rng = random.Random(9)
    lists = [[(i / 12, -100.0) for i in range(rng.randrange(1, 30))] for _ in range(60)]
    cases = [(k, [*flows, (len(flows) / 12 + rng.random(), len(flows) * rng.choice((1.0, 60.0, 100.0, 130.0, 9000.0)))]) for k, flows in enumerate(lists)]
    cases += [(98, []), (99, None)]
    rates = spark.createDataFrame(cases, "k INT, flows ARRAY<STRUCT<t: DOUBLE, a: DOUBLE>>").coalesce(1).select("k", backtest.xirr(F.col("flows")).alias("x"))
    assert "ArrowEvalPython" in rates._jdf.queryExecution().executedPlan().toString()  # no interpreted step per flow
    got = {r.k: r.x for r in rates.collect()}
    assert got == {k: pytest.approx(newton(flows), abs=2e-6) if flows and newton(flows) is not None else None for k, flows in cases}


# --- schedule ---------------------------------------------------------------------------

def test_schedule(spark):
    df = spark.createDataFrame([(D(2020, 1, 31), D(2020, 4, 30), "monthly"), (D(2020, 1, 15), D(2020, 12, 31), "quarterly"),
                                (D(2020, 1, 31), D(2020, 1, 30), "monthly"), (D(2020, 11, 30), D(2021, 2, 27), "monthly")],
                               "s DATE, e DATE, f STRING")
    got = [r.d for r in df.select(backtest.schedule(F.col("s"), F.col("e"), F.col("f")).alias("d")).collect()]
    assert got[0] == [D(2020, 1, 31), D(2020, 2, 28), D(2020, 3, 28), D(2020, 4, 28)]
    assert got[1] == [D(2020, 1, 15), D(2020, 4, 15), D(2020, 7, 15), D(2020, 10, 15)]
    assert got[2] == [] and got[3] == [D(2020, 11, 30), D(2020, 12, 28), D(2021, 1, 28)]


# --- backtests ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tables(spark, nav_of):
    nav = nav_of({"flat": series(400, start=D(2020, 1, 1)), "grow": growing(900, 12.0, start=D(2020, 1, 1)),
                  "three": [(D(2019, 1, 1), 100.0), (D(2020, 1, 1), 150.0), (D(2021, 1, 1), 200.0)],
                  "gappy": [(D(2020, 1, 6), 10.0), (D(2020, 2, 20), 20.0), (D(2020, 3, 5), 25.0), (D(2020, 3, 30), 40.0)]})
    master = spark.createDataFrame([("flat", "F Fund", "Debt Scheme - Liquid Fund"), ("grow", "G Fund", "Equity Scheme - ELSS"),
                                    ("three", "T Fund", None), ("gappy", "X", None), ("bare", "No prices", None)],
                                   "scheme_code STRING, name STRING, category STRING")
    return nav, master


def test_plan_validity(spark, tables):
    nav, master = tables
    plans = spark.createDataFrame([plan("ok", "three", 1, D(2019, 1, 1)), plan("early", "three", 1, D(2018, 12, 31)),
                                   plan("late", "three", 1, D(2021, 1, 1)), plan("unknown", "nope", 1, D(2020, 1, 1)),
                                   plan("bare", "bare", 1, D(2020, 1, 1))], PLANS)
    got = {k: (v["is_valid"], v["reason"], v["fund_cagr_pct"]) for k, v in rows_of(backtest.plan_validity(plans, master, nav), "plan_id").items()}
    assert got == {"ok": (True, None, 41.35), "early": (False, "starts before the fund's history", None),
                   "late": (False, "starts at or after the latest price", None), "unknown": (False, "unknown scheme", None),
                   "bare": (False, "no price history", None)}


def test_lumpsum(spark, tables):
    nav, _ = tables
    plans = spark.createDataFrame([plan("flat", "flat", 6000, D(2020, 1, 1)), plan("double", "three", 900, D(2019, 1, 1)),
                                   plan("after", "flat", 1000, D(2025, 1, 1)), plan("between", "gappy", 100, D(2020, 1, 7), D(2020, 1, 8))], PLANS)
    got = rows_of(backtest.lumpsum_summary(plans, nav), "plan_id")
    assert got["flat"]["gain"] == 0.0 and got["flat"]["units"] == 60.0 and got["flat"]["absolute_return_pct"] == 0.0
    assert got["double"]["absolute_return_pct"] == 100.0 and got["double"]["current_value"] == 1800.0
    assert got["double"]["cagr_pct"] == pytest.approx((2 ** (365 / 731) - 1) * 100, abs=0.006)
    assert "after" not in got
    # bought at the next price; the last instalment day plays no part
    assert got["between"]["start"] == D(2020, 2, 20) and got["between"]["current_value"] == 200.0
    points = [(r.date, r.value) for r in backtest.lumpsum_series(plans, nav).filter("plan_id = 'between'").orderBy("date").collect()]
    assert points == [(D(2020, 2, 20), 100.0), (D(2020, 3, 5), 125.0)]


def test_sip(spark, tables):
    nav, _ = tables
    plans = spark.createDataFrame([plan("flat", "flat", 700, D(2020, 1, 1)), plan("gap", "gappy", 60, D(2020, 1, 6)),
                                   plan("stop", "gappy", 60, D(2020, 1, 6), D(2020, 2, 5)), plan("early", "gappy", 60, D(2019, 12, 20)),
                                   plan("grow", "grow", 1000, D(2020, 1, 1), None, "quarterly")], PLANS)
    buys = backtest.sip_buys(plans, nav)
    got = rows_of(backtest.sip_summary(buys), "plan_id")
    assert got["flat"]["absolute_return_pct"] == 0.0 and got["flat"]["invested"] == 9800.0
    # 6 Jan at 10, 6 Feb at 20 on 20 Feb, 6 Mar at 40 on 30 Mar, all valued at 40
    assert got["gap"]["units"] == 10.5 and got["gap"]["current_value"] == 420.0 and got["gap"]["invested"] == 180.0
    assert got["stop"]["invested"] == 60.0 and got["stop"]["current_value"] == 240.0
    assert got["early"]["invested"] == 240.0 and got["early"]["end"] == D(2020, 3, 30)
    points = [(r.date, r.invested, r.value) for r in backtest.sip_series(buys).filter("plan_id = 'gap'").orderBy("instalment").collect()]
    assert points == [(D(2020, 1, 6), 60.0, 60.0), (D(2020, 2, 20), 120.0, 180.0), (D(2020, 3, 30), 180.0, 420.0)]
    rates = {k: v["xirr_pct"] for k, v in rows_of(backtest.sip_xirr(buys), "plan_id").items()}
    assert abs(rates["flat"]) < 0.01 and rates["grow"] == pytest.approx(12.0, abs=0.05)


def test_next_price_makes_no_day_calendar(spark, tables):
    nav, _ = tables
    plans = spark.createDataFrame([plan("gap", "gappy", 60, D(2020, 1, 6))], PLANS)
    plan_text = backtest.sip_buys(plans, nav)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan_text and "Generate explode(sequence" not in plan_text


# --- tax ----------------------------------------------------------------------------------

def test_tax_class(spark):
    cases = [("Equity Scheme - Value Fund", "Alder Value", "equity"), ("Hybrid Scheme - Conservative Hybrid Fund", "Alder Calm", "non_equity"),
             ("Debt Scheme - Overnight Fund", "Birch Night", "non_equity"), ("Debt Scheme - Floater Fund", "", "non_equity"),
             ("Other Scheme - Silver ETF", "Maple Silver", "non_equity"), ("Index Fund", "Maple Sensex Index Fund", "equity"),
             ("Other Scheme - FoF Overseas", "Maple World FoF", "non_equity"), (None, None, "equity"), ("Money Market", None, "non_equity")]
    df = spark.createDataFrame(cases, "c STRING, n STRING, want STRING")
    assert [r.want for r in df.collect()] == [r.got for r in df.select(tax.tax_class(F.col("c"), F.col("n")).alias("got")).collect()]


def test_tax_amounts(spark):
    # the exemption is 125,000 and the rates are 20% and 12.5%
    cases = [(-1.0, 700, "equity", 0.1, "none", 0.0, 0.0), (36000.0, 364, "equity", 0.1, "STCG", 7200.0, 20.0), (325000.0, 365, "equity", 0.1, "LTCG", 25000.0, 7.69),
             (125000.0, 2000, "equity", 0.1, "LTCG", 0.0, 0.0), (325000.0, None, "equity", 0.1, "LTCG", 25000.0, 7.69), (40000.0, 9, "non_equity", 0.15, "slab", 6000.0, 15.0)]
    df = spark.createDataFrame(cases, "g DOUBLE, d INT, c STRING, r DOUBLE, kind STRING, tax DOUBLE, eff DOUBLE")
    kind = tax.gain_type(F.col("g"), F.col("d"), F.col("c"))
    for row in df.select("*", kind.alias("k"), tax.tax_amount(F.col("g"), kind, F.col("r")).alias("t"),
                         tax.effective_rate_pct(F.col("g"), kind, F.col("r")).alias("e")).collect():
        assert (row.k, row.t, row.e) == (row.kind, row.tax, row.eff)


def test_a_plan_without_a_rate_is_taxed_at_the_default_slab(spark, tables):
    nav, master = tables
    plans = spark.createDataFrame([plan("a", "grow", 1000, D(2020, 1, 1), rate=None)], PLANS).withColumn("tax_class", F.lit("non_equity"))
    summary = backtest.lumpsum_summary(plans, nav)
    assert plan_tax(summary, plans, master).first().tax == pytest.approx(summary.first().gain * 0.3, abs=0.01)


def test_plan_tax_reads_class_and_takes_an_override(spark, tables):
    nav, master = tables
    plans = spark.createDataFrame([plan("a", "grow", 1000000, D(2020, 1, 1)), plan("b", "grow", 1000000, D(2020, 1, 1), rate=10.0)], PLANS)
    summary = backtest.lumpsum_summary(plans, nav)
    got = rows_of(plan_tax(summary, plans.withColumn("tax_class", F.when(F.col("plan_id") == "b", "non_equity")), master), "plan_id")
    gain = rows_of(summary, "plan_id")["a"]["gain"]
    assert got["a"]["gain_type"] == "LTCG" and got["a"]["tax"] == pytest.approx((gain - 125000) * 0.125, abs=0.01)
    assert got["b"]["gain_type"] == "slab" and got["b"]["tax"] == pytest.approx(gain * 0.1, abs=0.01)


# --- projections -----------------------------------------------------------------------------

SCENARIOS = "scenario_id STRING, amount DOUBLE, years DOUBLE, annual_rate DOUBLE, corpus DOUBLE, monthly_withdrawal DOUBLE"


def test_project_plans(spark):
    df = spark.createDataFrame([("lump", 8000.0, 7.0, 9.0, 1.0, 1.0), ("sip", 750.0, 2.5, 6.0, 1.0, 1.0), ("zero", 300.0, 2.0, 0.0, 6000.0, 1.0),
                                ("goal", 1.0, 8.0, 10.0, 450000.0, 1.0), ("none", 1.0, 0.0, 12.0, 1000.0, 1.0), ("half", 1.0, 0.375, 0.0, 1.0, 1.0)], SCENARIOS)
    got = rows_of(projections.project_plans(df), "scenario_id")
    assert got["lump"]["lump_value"] == pytest.approx(8000 * 1.09 ** 7, abs=0.005) and got["lump"]["lump_gain"] == pytest.approx(8000 * (1.09 ** 7 - 1), abs=0.005)
    paid = sum(750 * 1.005 ** k for k in range(1, 31))  # each at the start of its month
    assert got["sip"]["months"] == 30 and got["sip"]["sip_invested"] == 22500 and got["sip"]["sip_value"] == pytest.approx(paid, abs=0.005)
    assert got["zero"]["sip_value"] == 7200 and got["zero"]["sip_gain"] == 0 and got["zero"]["goal_monthly"] == 250
    back = spark.createDataFrame([("x", got["goal"]["goal_monthly"], 8.0, 10.0, 1.0, 1.0)], SCENARIOS)
    assert projections.project_plans(back).collect()[0].sip_value == pytest.approx(450000, rel=1e-3)
    assert got["none"]["goal_monthly"] is None
    assert got["half"]["months"] == 4  # 4.5 months round to even


def test_the_horizon_is_a_parameter(spark):
    df = spark.createDataFrame([("x", 0.0, 0.0, 0.0, 3000.0, 100.0)], SCENARIOS)
    assert projections.withdrawal_summary(df).first().lasts_months == 30
    assert projections.withdrawal_summary(df, max_years=2).first().sustained is True
    assert [r.year for r in projections.withdrawal_schedule(df, max_years=1).collect()] == [1]


def iterate(corpus, w, rate):
    r, bal, months, schedule = rate / 100 / 12, corpus, 0, []
    while bal > 0 and months < 720:
        bal = bal * (1 + r) - w
        months += 1
        if months % 12 == 0:
            schedule.append((months // 12, round(max(bal, 0), 2)))
    return (months if bal <= 0 and months < 720 else None), schedule


def test_withdrawals_match_month_by_month(spark):
    cases = [(1200000.0, 10000.0, 12.0), (100000.0, 10000.0, 0.0), (100000.0, 900.0, 5.0), (720000.0, 1000.0, 0.0), (719000.0, 1000.0, 0.0),
             (50000.0, 60000.0, 8.0), (100000.0, 1000.0, 12.0), (500000.0, 3333.0, 7.25), (100.0, 100.0, 0.0), (100000.0, 5000.0, -3.0), (1000.0, 0.0, 0.0), (0.0, 100.0, 5.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(str(i), 0.0, 0.0, rate, c, w) for i, (c, w, rate) in enumerate(cases)], SCENARIOS)
    summary = rows_of(projections.withdrawal_summary(df), "scenario_id")
    schedule = {}
    for r in projections.withdrawal_schedule(df).orderBy("year").collect():
        schedule.setdefault(r.scenario_id, []).append((r.year, r.balance))
    for i, (c, w, rate) in enumerate(cases):
        months, years = iterate(c, w, rate)
        assert (summary[str(i)]["lasts_months"], summary[str(i)]["sustained"]) == (months, months is None), (c, w, rate)
        mine = schedule.get(str(i), [])
        assert [y for y, _ in mine] == [y for y, _ in years]
        assert all(a == pytest.approx(b, rel=1e-9, abs=0.02) for (_, a), (_, b) in zip(mine, years))


def test_running_units_equal_single_instalments(spark, nav_of):
    """Plans on every kind of day and step, with gaps, a price of 0 and last instalments before, at and after a due day."""
    rng = random.Random(3)
    days = [D(2018, 1, 5) + dt.timedelta(days=i) for i in range(1200) if rng.random() < 0.6]
    nav = nav_of({"a": [(d, 10 + i % 7) for i, d in enumerate(days)], "b": [(d, 0.0 if i % 50 == 0 else 5 + i / 100) for i, d in enumerate(days)],
                  "zero": [(d, 0.0) for d in days]})
    rows = []
    for i in range(400):
        start = days[0] + dt.timedelta(days=rng.randrange(1100))
        last = rng.choice([None, start, start + dt.timedelta(days=rng.randrange(-5, 700)), (start.replace(day=1) + dt.timedelta(days=400)).replace(day=min(start.day, 28))])
        rows.append(plan(f"p{i}", rng.choice(["a", "a", "b", "zero"]), rng.choice([500, 999.99]), start, last, rng.choice(["monthly", "quarterly", None])))
    plans = spark.createDataFrame(rows, PLANS)
    single = rows_of(backtest.sip_summary(backtest.sip_buys(plans, nav)), "plan_id")
    running = rows_of(backtest.plan_summary(plans, nav), "plan_id")
    assert len(single) > 300 and running == single
    chains = backtest.unit_chains(plans, nav)
    assert chains.groupBy("scheme_code").count().agg(F.max("count")).first()[0] <= 28 * 2 * 41
    twice = plans.withColumn("plan_id", F.concat("plan_id", F.lit("-again"))).unionByName(plans)
    assert backtest.unit_chains(twice, nav).count() == chains.count()
