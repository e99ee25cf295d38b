import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from navloom import session
from navloom.plans import explorer, paging, quality, search
from tests.conftest import growing, rows_of

D = dt.date
CARD = ("scheme_code STRING, name STRING, amc STRING, category STRING, plan_type STRING, option_type STRING, is_active BOOLEAN, "
        "data_quality STRING, nav DOUBLE, nav_date DATE, ret_1y DOUBLE, ret_3y DOUBLE, ret_5y DOUBLE, sharpe_3y DOUBLE, "
        "percentile_3y DOUBLE, aaum_cr DOUBLE")


def scheme(code, name, amc="Alder", ret3=None, plan="Direct", active=True, flag=None, pct=None, category="Flexi"):
    return code, name, amc, category, plan, "Growth", active, flag, 10.0, D(2026, 1, 1), None, ret3, None, None, pct, None


@pytest.fixture(scope="module")
def card(spark):
    return spark.createDataFrame([
        scheme("1", "Beta Fund", ret3=12.0, pct=100.0), scheme("2", "Alpha Fund", ret3=12.0, pct=40.0), scheme("3", "Gamma Fund"),
        scheme("4", "Old Fund", ret3=50.0, flag="stale"), scheme("5", "Shut Fund", ret3=50.0, active=False),
        scheme("6", "Delta Fund", amc="BIRCH House", ret3=-1.0, plan="Regular", pct=0.0, category=None)], CARD)


def codes(df):
    return [r.scheme_code for r in df.collect()]


def test_order_puts_nulls_last_and_breaks_ties_by_name(card):
    assert codes(explorer.explorer_page(card)) == ["2", "1", "6", "3"]
    assert codes(explorer.explorer_page(card, descending=False)) == ["6", "2", "1", "3"]
    assert codes(explorer.explorer_page(card, sort="name")) == ["3", "6", "1", "2"]


def test_pages_and_filters(card):
    assert codes(explorer.explorer_page(card, page=2, page_size=3)) == ["3"]
    assert codes(explorer.explorer_page(card, q="birch")) == ["6"]
    assert codes(explorer.explorer_page(card, q="_lpha")) == ["2"]
    assert codes(explorer.explorer_page(card, plan_type="Regular", option_type="Growth")) == ["6"]
    assert explorer.match_count(card).collect()[0].total == 4
    assert explorer.match_count(card, category="Flexi").collect()[0].total == 3
    with pytest.raises(ValueError):
        explorer.explorer_page(card, sort="nav; drop")


def test_top_share(card):
    share = rows_of(explorer.explorer_page(card), "scheme_code")
    assert {k: v["top_share_3y"] for k, v in share.items()} == {"1": 1, "2": 60, "3": None, "6": 100}


def test_facets(card):
    assert [(r.facet, r.value, r["count"]) for r in explorer.facets(card).collect()] == [
        ("amc", "Alder", 3), ("amc", "BIRCH House", 1), ("category", "Flexi", 3)]


def test_quality_note(spark):
    df = spark.createDataFrame([("stale", D(2020, 1, 1)), ("stale", None), ("discontinuity", None), (None, None)], "q STRING, d DATE")
    label, text = quality.quality_note(F.col("q"), F.col("d"))
    rows = df.select(label.alias("l"), text.alias("t")).collect()
    assert "2020-01-01" in rows[0].t and "unknown" in rows[1].t and "40%" in rows[2].t
    assert rows[3].l is None and rows[3].t is None


def test_chart_points_keep_the_newest(spark, nav_of):
    nav = growing(365 * 6, 8.0)
    points = {}
    for r in explorer.chart_points(nav_of({"x": nav})).collect():
        points.setdefault(r.range, []).append(r.date)
    latest = nav[-1][0]
    assert set(points) == {"1Y", "3Y", "5Y", "max"}
    assert all(max(days) == latest and len(days) <= 400 for days in points.values())
    assert len(points["1Y"]) == 366 and min(points["1Y"]) == latest - dt.timedelta(days=365)
    # 1096 days in steps of 3
    assert len(points["3Y"]) == 366 and (latest - sorted(points["3Y"])[-2]).days == 3


def test_freshness(spark, nav_of):
    dated = spark.createDataFrame([("x", D(2026, 6, 1))], "scheme_code STRING, as_of_date DATE")
    rows = rows_of(explorer.freshness(nav_of({"x": [(D(2026, 7, 12), 1.0)]}), dated, dated.filter("false"), "2026-07-16"), "source")
    assert (rows["nav"]["age_days"], rows["nav"]["stale"]) == (4, False)
    assert (rows["holdings"]["age_days"], rows["holdings"]["stale"]) == (45, False)
    assert (rows["costs"]["latest"], rows["costs"]["age_days"], rows["costs"]["stale"]) == (None, None, True)
    late = rows_of(explorer.freshness(nav_of({"x": [(D(2026, 7, 11), 1.0)]}), dated, dated, "2026-07-16"), "source")
    assert late["nav"]["stale"] is True


def test_period_rows(spark):
    rets = spark.createDataFrame([("f", "1Y", 9.0, D(2026, 1, 1)), ("f", "10Y", 8.0, D(2026, 1, 1)), ("p", "1Y", 7.0, D(2026, 1, 1))],
                                 "scheme_code STRING, period STRING, ret DOUBLE, as_of_date DATE")
    master = spark.createDataFrame([("f", "c"), ("p", None)], "scheme_code STRING, category STRING")
    stats = spark.createDataFrame([("c", "1Y", 8.5)], "category STRING, period STRING, avg_return DOUBLE")
    proxies = spark.createDataFrame([("c", "p"), ("d", "p")], "category STRING, proxy_scheme_code STRING")
    rows = rows_of(explorer.period_rows(master, rets, stats, proxies), "scheme_code", "period")
    assert (rows["f", "1Y"]["benchmark_return"], rows["f", "1Y"]["category_avg_return"], rows["f", "1Y"]["position"]) == (7.0, 8.5, 4)
    assert rows["f", "10Y"]["benchmark_return"] is None and rows["p", "1Y"]["benchmark_return"] is None and len(rows) == 3


def test_fund_queries_need_no_text_package():
    """With a package of the text operators blocked, and without their folders, all other queries are there."""
    code = ("import sys; sys.path.insert(0, {root!r}); sys.modules.update({blocked!r})\n"
            "import __spark_entry__ as e; print(len(e.queries()), 'scheme_returns' in e.queries(), 'op1_minhash_dedup' in e.queries())")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for blocked in ("tiktoken", "zstandard", "navloom.llm", "corpus_pipeline"):
        script = code.replace("{root!r}", repr(root)).replace("{blocked!r}", f"{{{blocked!r}: None}}")
        out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) >= 70 and out[1] == "True"


def test_scratch_on_one_machine_is_refused_on_a_cluster(spark, monkeypatch):
    shared = spark.conf.get("spark.checkpoint.dir")

    class Elsewhere:
        conf, _jvm = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}, spark._jvm

        class sparkContext:
            master, applicationId, _jvm, _jsc = "spark://host:7077", "app", spark.sparkContext._jvm, spark.sparkContext._jsc

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Elsewhere, "x")
    Elsewhere.conf = {"spark.checkpoint.dir": shared}
    assert session.scratch_dir(Elsewhere, "x").startswith(shared)
    Elsewhere.conf, Elsewhere.sparkContext.master = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}, "local[4]"
    assert session.scratch_dir(Elsewhere, "x").startswith("file:/tmp/warehouse/navloom-app")


def test_search_through_trigrams_equals_a_scan(spark, tmp_path):
    names = ["Birch Flexi Fund", "BIRCH & Oak 50% Fund", "Abirchy", "bi", "", None, "Batch_Fund", "Ünïon Birch Élan", "aaa", "aaaa Fund", "\u212aelvin Fund"]
    rows = [(f"s{i}", name, house) for i, name in enumerate(names) for house in ("Alder Mutual Fund",)] + [("h1", "x", "Birch House"), ("h2", None, None), ("h3", "bir", "rch")]
    card = spark.createDataFrame(rows, "scheme_code STRING, name STRING, amc STRING")
    path = str(tmp_path / "index")
    search.write_index(card, path)
    for q in ("birch", "BIRCH", "b_rch", "b%fund", "fund", "50%", "aaa", "aaaa", "élan", "bi", "%", "ich", "lder mut", "kelvin", "zzz", "h_Fu", "birch flexi fund"):
        scan = {r.scheme_code for r in card.filter(F.col("name").ilike(f"%{q}%") | F.col("amc").ilike(f"%{q}%")).collect()}
        through = search.narrowed(card, path, q)
        assert {r.scheme_code for r in through.filter(F.col("name").ilike(f"%{q}%") | F.col("amc").ilike(f"%{q}%")).collect()} == scan
    assert search.pattern_grams("bi%c_h") == [] and search.candidates(spark, path, "b_") is None and search.narrowed(card, path, None) is card
    assert {r.scheme_code for r in search.candidates(spark, path, "b_rch").collect()} == {"s0", "s1", "s2", "s7", "h1", "h3"}
    plan = search.candidates(spark, path, "birch")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "In(gram" in plan


@pytest.mark.parametrize("part_rows", [4, 30, 1000])
def test_pages_from_the_stored_order(spark, tmp_path, part_rows):
    """Every page equals its slice of the sorted rows, ties and nulls too, and reads only the parts that hold it."""
    rows = [(i, None if i % 9 == 0 else float(i * 37 % 11)) for i in range(101)]
    df, order, path = spark.createDataFrame(rows, "code INT, x DOUBLE"), [F.col("x").desc_nulls_last(), F.asc("code")], str(tmp_path / "order")
    paging.write_order(df, order, path, part_rows)
    expected = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    parts = spark.read.parquet(f"{path}/parts").count()
    assert parts == 1 if part_rows == 1000 else parts > 2
    for size in (7, 50):
        for number in range(1, 101 // size + 3):
            page = paging.page(spark, path, order, number, size)
            assert [tuple(r) for r in page.collect()] == expected[(number - 1) * size:number * size]
            if part_rows == 30 and size == 7 and number <= 15:
                assert len(page.inputFiles()) <= 2


def test_pages_of_nothing(spark, tmp_path):
    order = [F.asc("code")]
    paging.write_order(spark.createDataFrame([], "code INT, x DOUBLE"), order, str(tmp_path / "order"))
    page = paging.page(spark, str(tmp_path / "order"), order, 1, 10)
    assert page.columns == ["code", "x"] and page.count() == 0
