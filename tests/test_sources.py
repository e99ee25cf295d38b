import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from navloom import constants as K
from navloom import schemas, session
from navloom.functions import feeds, names
from navloom.operators import merge, resolve
from navloom.session import scratch_dir
from navloom.sources import costs, holdings, master, nav_text, prices, sheets, versions
from navloom.streaming import ingest
from tests.conftest import rows_of
from workload import queries

D = dt.date
HEADER_8 = "Scheme Code;ISIN Div Payout/ ISIN Growth;ISIN Div Reinvestment;Scheme Name;Plan;Option;Net Asset Value;Date"
SECTION, HOUSE = "Open Ended Schemes ( Hybrid Scheme - Balanced Fund )", "Alder Mutual Fund"


def column(spark, fn, *values, kind="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


# --- daily file -------------------------------------------------------------------------

def test_lines_of_six_and_eight_fields(spark, tmp_path):
    (tmp_path / "nav.txt").write_text("\n".join([
        SECTION, "", HOUSE, HEADER_8,
        "501;INFA00000501;-;Alder Harvest Fund;Direct Plan;Growth;17.125;04-Mar-2027",
        "502;-;INFA00000502;Alder Harvest Fund;Regular Plan;IDCW-Payout;12.5;04-Mar-2027",
        "503;INFA00000503;-;Alder Harvest Fund - Regular Plan - Growth;16.75;04-Mar-2027",
        "Close Ended Schemes(Debt)", "Birch Mutual Fund",
        "601;;-;Birch Ladder 2029;;;10;04-Mar-2027",
        "602;INFB;-;Birch Ladder 2030;Direct Plan;Growth;N.A.;unknown",
        "Open Ended Schemes ( Debt Scheme - Short Fund )",
        "\t603;INFB;-;Birch Short;Direct Plan;Growth;8;2027-03-04\t\r"]))
    rows = rows_of(nav_text.parse_lines(nav_text.read_lines(spark, str(tmp_path))), "scheme_code")
    eight, payout, six = rows["501"], rows["502"], rows["503"]
    assert (eight["nav"], eight["nav_date"], eight["plan_type"], eight["option_type"], eight["amc"]) == (17.125, D(2027, 3, 4), "Direct", "Growth", HOUSE)
    assert (eight["scheme_type"], eight["category"], eight["sub_category"]) == ("Open Ended Schemes", "Hybrid Scheme - Balanced Fund", "Balanced Fund")
    assert (payout["plan_type"], payout["option_type"], payout["isin"]) == ("Regular", "IDCW", "INFA00000502")
    assert (six["nav"], six["plan_type"], six["option_type"]) == (16.75, "Regular", "Growth")
    assert six["fund_group_id"] == eight["fund_group_id"] == payout["fund_group_id"]
    bare = rows["601"]
    assert bare["plan_type"] is None and bare["option_type"] is None and bare["isin"] is None and bare["sub_category"] is None
    assert rows["602"]["nav"] is None and rows["602"]["nav_date"] is None
    # a section without a house line keeps the house before it
    assert (rows["603"]["amc"], rows["603"]["sub_category"]) == ("Birch Mutual Fund", "Short Fund")
    assert len(rows) == 6 and prices.daily_rows(nav_text.parse_lines(nav_text.read_lines(spark, str(tmp_path)))).count() == 5


def test_context_is_carried_over_scan_splits(spark, tmp_path):
    lines = []
    for s in range(7):
        lines.append(f"Open Ended Schemes ( Kind {s} - Sub {s} )")
        for h in range(3):
            lines.append(f"House {s}-{h} Mutual Fund")
            lines += [f"{s}{h}{i:04d};INF;-;Fund {i};Direct Plan;Growth;10.5;25-Aug-2026" for i in range(400)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows = nav_text.parse_lines(nav_text.read_lines(spark, str(tmp_path))).select("scheme_code", "category", "amc").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 7 * 3 * 400
    assert all(r.category == f"Kind {r.scheme_code[0]} - Sub {r.scheme_code[0]}" and
               r.amc == f"House {r.scheme_code[0]}-{r.scheme_code[1]} Mutual Fund" for r in rows)


def test_plan_and_option_words(spark):
    assert column(spark, names.option_type, "MONTHLY DCW Payout", "IDCW-Re-investment", "Growth", "Income Distribution", "Bonus") == \
        ["IDCW", "IDCW", "Growth", "IDCW", None]
    assert column(spark, names.plan_type, "Direct Plan", "Regular Plan", "Regular Direct", "Directed", "") == \
        ["Direct", "Regular", "Direct", None, None]


def test_codes_sectors_and_houses(spark):
    assert column(spark, names.is_isin, "QQ0000000017", " QQ0000000017 ", "QQ00000000X7Z", "QQ000000001X", "", None) == [True, True, False, False, False, False]
    assert column(spark, names.clean_sector, "Shipping^", "", None, "ICRA AA+", "**", "Paper Mills") == \
        ["Shipping", "Cash & Equivalents", "Cash & Equivalents", "Debt / Money Market", "Cash & Equivalents", "Paper Mills"]
    assert column(spark, names.clean_instrument, "Harbour Lines Ltd $$ ~~", "Quarry Ltd #", "Orchard Foods") == ["Harbour Lines Ltd", "Quarry Ltd", "Orchard Foods"]
    assert column(spark, names.house_key, "Alder Mutual Fund", "Birch & Sons Mutual-Fund", None) == ["alder", "birch sons", ""]


# --- history, merges, store, stream ------------------------------------------------------------

def test_history_documents(spark, tmp_path):
    doc = {"scheme_code": "7", "data": [{"date": "25-08-2026", "nav": "10.5"}, {"date": "26-08-2026", "nav": "0"},
                                        {"date": "bad", "nav": "1"}, {"date": "27-08-2026", "nav": "x"}, {"nav": "3"}]}
    (tmp_path / "h.json").write_text(json.dumps(doc) + "\n" + json.dumps({"scheme_code": "8", "data": []}))
    assert [tuple(r) for r in prices.read_history(spark, str(tmp_path)).collect()] == [("7", D(2026, 8, 25), 10.5)]


def test_price_merges(nav_of):
    day = D(2026, 8, 25)
    old, new = nav_of({"a": [(day, 1.0)], "b": [(day, 2.0)]}), nav_of({"b": [(day, 3.0), (day, 2.5)], "c": [(day, 4.0)]})
    assert {r.scheme_code: r.nav for r in prices.upserted(old, new).collect()} == {"a": 1.0, "b": 3.0, "c": 4.0}
    assert {r.scheme_code: r.nav for r in prices.backfilled(old, new).collect()} == {"a": 1.0, "b": 2.0, "c": 4.0}


def by_day(df):
    return {(r.scheme_code, r.date, r.nav) for r in df.collect()}


def test_price_store(spark, nav_of, tmp_path):
    store = str(tmp_path / "nav")
    first = prices.write_prices(nav_of({"a": [(D(2024, 5, 1), 1.0), (D(2025, 5, 1), 2.0), (D(2025, 5, 1), 2.0)]}), store)
    change = nav_of({"a": [(D(2025, 5, 1), 9.0), (D(2026, 1, 1), 3.0)]})
    for _ in range(2):
        prices.merge_into_store(spark, store, change)
    last = prices.merge_into_store(spark, store, nav_of({"a": [(D(2025, 5, 1), 7.0), (D(2025, 5, 2), 8.0)]}), incoming_wins=False)
    assert by_day(prices.read_prices(spark, store)) == {
        ("a", D(2024, 5, 1), 1.0), ("a", D(2025, 5, 1), 9.0), ("a", D(2025, 5, 2), 8.0), ("a", D(2026, 1, 1), 3.0)}
    # an untouched month keeps its files, and reading one month opens no other
    assert last.number == 4 and last.runs["2024-05"] == first.runs["2024-05"] and set(last.runs) == {"2024-05", "2025-05", "2026-01"}
    assert {"2025-05", "2026-01"} == {f.split("_part=")[1][:7] for f in prices.read_prices(spark, store, [(2026, 1), (2025, 5), (1999, 1)]).inputFiles()}
    assert versions.merge(nav_of({}), store, "scheme_code STRING, date DATE, nav DOUBLE", prices._MONTH, ["date"], prices.upserted) == last


def test_a_reader_keeps_the_version_it_opened(spark, nav_of, tmp_path):
    store = str(tmp_path / "nav")
    prices.write_prices(nav_of({"a": [(D(2025, 5, 1), 1.0)], "b": [(D(2025, 6, 1), 2.0)]}), store)
    opened, pinned = prices.read_prices(spark, store), versions.pin(spark, store)
    old = {("a", D(2025, 5, 1), 1.0), ("b", D(2025, 6, 1), 2.0)}
    seen = []

    def combine(stored, incoming):  # a reader in the middle of the merge
        seen.append((by_day(opened), by_day(prices.read_prices(spark, store))))
        return prices.upserted(stored, incoming)

    versions.merge(nav_of({"a": [(D(2025, 5, 1), 5.0)], "c": [(D(2025, 7, 1), 7.0)]}), store, "scheme_code STRING, date DATE, nav DOUBLE", prices._MONTH, ["date"], combine)
    assert seen == [(old, old)] and by_day(opened) == old and by_day(prices.read_prices(spark, store, version=pinned)) == old
    assert by_day(prices.read_prices(spark, store)) == {("a", D(2025, 5, 1), 5.0), ("b", D(2025, 6, 1), 2.0), ("c", D(2025, 7, 1), 7.0)}


def test_a_merge_that_died_leaves_the_last_version(spark, nav_of, tmp_path, monkeypatch):
    store = str(tmp_path / "nav")
    prices.write_prices(nav_of({"a": [(D(2025, 5, d), float(d)) for d in range(1, 11)]}), store)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            prices.merge_into_store(spark, store, nav_of({"a": [(D(2025, 5, 11), 11.0)]}))
    assert sorted(r.nav for r in prices.read_prices(spark, store).collect()) == [float(d) for d in range(1, 11)]
    assert len(list((tmp_path / "nav" / "data").iterdir())) == 2
    prices.merge_into_store(spark, store, nav_of({"a": [(D(2025, 5, 12), 12.0)]}))
    versions.expire(spark, store, keep=1)  # a young run may still be published
    assert len(list((tmp_path / "nav" / "data").iterdir())) == 3 and versions.versions(spark, store) == [2]
    versions.expire(spark, store, keep=1, grace_s=-60)
    assert len(list((tmp_path / "nav" / "data").iterdir())) == 1
    assert sorted(r.nav for r in prices.read_prices(spark, store).collect()) == [*map(float, range(1, 11)), 12.0]
    with pytest.raises(ValueError):
        versions.pin(spark, store, 1)


def test_two_merges_at_once_lose_nothing(spark, nav_of, tmp_path):
    store = str(tmp_path / "nav")
    prices.write_prices(nav_of({"a": [(D(2025, 5, 1), 1.0)]}), store)
    rivals = [nav_of({"r": [(D(2025, 5, 2), 2.0)]})]

    def combine(stored, incoming):  # another merge publishes while this one is at work
        if rivals:
            prices.merge_into_store(spark, store, rivals.pop())
        return prices.upserted(stored, incoming)

    found = versions.merge(nav_of({"a": [(D(2025, 5, 3), 3.0)]}), store, "scheme_code STRING, date DATE, nav DOUBLE", prices._MONTH, ["date"], combine)
    assert found.number == 3
    assert by_day(prices.read_prices(spark, store)) == {("a", D(2025, 5, 1), 1.0), ("r", D(2025, 5, 2), 2.0), ("a", D(2025, 5, 3), 3.0)}
    with pytest.raises(versions.Taken):
        versions._publish(spark, store, versions.Version(3, {}))
    assert versions.versions(spark, store) == [1, 2, 3]


def test_holdings_store(spark, tmp_path):
    store = str(tmp_path / "holdings")
    jun, jul = D(2026, 6, 30), D(2026, 7, 31)
    schema = "scheme_code STRING, as_of_date DATE, instrument_name STRING, isin STRING, sector STRING, pct_of_aum DOUBLE, market_value_cr DOUBLE"

    def rows(*lines):
        return spark.createDataFrame([(c, d, "n", i, "s", p, 1.0) for c, d, i, p in lines], schema)

    first = holdings.write_holdings(rows(("f", jun, "X", 1.0), ("f", jun, "Y", 2.0), ("g", jun, "X", 3.0), ("f", jul, "Z", 4.0), ("h", None, "X", 9.0)), store)
    opened = holdings.read_holdings(spark, store)
    for _ in range(2):
        last = holdings.replace_in_store(store, rows(("f", jun, "W", 5.0), ("k", jun, "X", 6.0)))
    got = {(r.scheme_code, r.as_of_date, r.isin, r.pct_of_aum) for r in holdings.read_holdings(spark, store).collect()}
    assert got == {("f", jun, "W", 5.0), ("g", jun, "X", 3.0), ("k", jun, "X", 6.0), ("f", jul, "Z", 4.0)}
    assert opened.count() == 4 and last.runs["2026-07-31"] == first.runs["2026-07-31"]
    assert holdings.read_holdings(spark, store, dates=["2026-07-31"]).count() == 1


def test_stream_of_daily_files(spark, tmp_path):
    landing, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    landing.mkdir()

    def land(name, price, date):
        (landing / name).write_text(f"{SECTION}\n{HOUSE}\n{HEADER_8}\n5;I;-;F;Direct Plan;Growth;{price};{date}\n")
        ingest.ingest_daily_files(spark, str(landing), store, checkpoint).awaitTermination()

    land("1.txt", "10", "25-Aug-2026")
    land("2.txt", "11", "26-Aug-2026")
    land("3.txt", "9.5", "31-Dec-2025")  # late
    land("4.txt", "10.5", "25-Aug-2026")  # corrected
    ingest.ingest_daily_files(spark, str(landing), store, checkpoint).awaitTermination()  # nothing new
    assert {(r.date, r.nav) for r in prices.read_prices(spark, store).collect()} == {
        (D(2025, 12, 31), 9.5), (D(2026, 8, 25), 10.5), (D(2026, 8, 26), 11.0)}


def test_master_sync(spark):
    parsed = spark.createDataFrame([("1", D(2026, 8, 25), "New"), ("3", D(2026, 8, 25), "Third"), ("3", D(2026, 8, 24), "Older")],
                                   "scheme_code STRING, nav_date DATE, name STRING")
    parsed = parsed.select("*", *(F.lit("v").alias(c) for c in ("amc", "scheme_type", "category", "sub_category", "plan_type", "option_type", "isin", "fund_group_id")))
    old = spark.createDataFrame([("1", "Old", D(2020, 1, 1), D(2026, 1, 1), False), ("2", "Gone", D(2020, 1, 1), D(2026, 7, 1), True),
                                 ("4", "Edge", D(2020, 1, 1), D(2026, 7, 27), True)],
                                "scheme_code STRING, name STRING, first_seen DATE, last_seen DATE, is_active BOOLEAN")
    old = old.select("*", *(F.lit("o").alias(c) for c in ("amc", "scheme_type", "category", "sub_category", "plan_type", "option_type", "isin", "fund_group_id")))
    old = old.withColumn("backfill_status", F.lit("done"))
    synced = rows_of(master.synced(old, parsed, "2026-08-26"), "scheme_code")
    got = {k: (v["name"], v["is_active"], v["first_seen"], v["last_seen"]) for k, v in synced.items()}
    assert {k: v["backfill_status"] for k, v in synced.items()} == {"1": "done", "2": "done", "3": None, "4": "done"}
    today = D(2026, 8, 26)
    assert got == {"1": ("New", True, D(2020, 1, 1), today), "2": ("Gone", False, D(2020, 1, 1), D(2026, 7, 1)),
                   "3": ("Third", True, today, today), "4": ("Edge", True, D(2020, 1, 1), D(2026, 7, 27))}


def test_backfill_marks(spark, nav_of):
    table = spark.createDataFrame([("1", "done", None), ("2", None, None), ("3", None, None)],
                                  "scheme_code STRING, backfill_status STRING, backfill_date DATE")
    todo = merge.pending(table.select("scheme_code"), table, "scheme_code")
    marks = master.backfill_marks(todo, nav_of({"2": [(D(2020, 1, 1), 1.0), (D(2020, 1, 2), 1.0)]}), "2026-08-26")
    got = {k: (v["backfill_status"], v["backfill_date"]) for k, v in rows_of(master.marked(table, marks), "scheme_code").items()}
    assert got == {"1": ("done", None), "2": ("done", D(2026, 8, 26)), "3": ("no_data", D(2026, 8, 26))}


def test_scratch_folder_is_the_configured_one(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_pending_and_replace(spark):
    status = spark.createDataFrame([("1", "done"), ("2", None), ("3", "error")], "scheme_code STRING, backfill_status STRING")
    assert [r.scheme_code for r in merge.pending(status.select("scheme_code"), status, "scheme_code").collect()] == ["2"]
    old = spark.createDataFrame([("f", 1, "a"), ("f", 1, "b"), ("f", 2, "c")], "s STRING, d INT, x STRING")
    new = spark.createDataFrame([("f", 1, "z")], old.schema)
    assert sorted((r.d, r.x) for r in merge.replace_groups(old, new, ["s", "d"]).collect()) == [(1, "z"), (2, "c")]


# --- expense ratios and sizes --------------------------------------------------------------------

def test_only_plausible_ratios_pass(spark):
    assert column(spark, feeds.plausible_ter, "1.2345", "0.0100", "0", None, "n/a", "17.5", "3.0001", "3.000", "-1") == \
        [1.2345, 0.01, None, None, None, None, None, 3.0, None]


TER = "mf_name STRING, ordinal BIGINT, Scheme_Name STRING, R_TER STRING, D_TER STRING, TER_Date STRING"


def test_newest_record_of_a_name_wins(spark):
    records = [("H", i, "Often", "2.1", "1.1", "2027-02-01T00:00:00Z") for i in range(30)]
    records += [("H", 40, "Moved", "1.9", "0.8", "2027-02-01"), ("H", 41, "Moved", "1.8", "0.7", "2027-02-19T12:00:00Z"), ("H", 42, "", "1", "1", "2027-02-01"),
                ("H", 50, "Twice", "1.1", "0.1", "2027-02-01"), ("H", 51, "Twice", "1.2", "0.2", "2027-02-01"),
                ("H", 60, "Undated", "1.3", "0.3", "soon"), ("H", 61, "Undated", "1.4", "0.4", "2020-01-01")]
    got = {k: (v["r_ter"], v["d_ter"]) for k, v in rows_of(costs.latest_ter(spark.createDataFrame(records, TER)), "scheme_name").items()}
    assert got == {"Often": (2.1, 1.1), "Moved": (1.8, 0.7), "Twice": (1.1, 0.1), "Undated": (1.4, 0.4)}


def test_ratios_reach_every_plan_of_a_fund(spark):
    schemes = spark.createDataFrame([("H1", "Alder Harvest Fund", "Alder Mutual Fund", "Direct"), ("H2", "Alder Harvest Fund", "Alder Mutual Fund", "Regular"),
                                     ("Q1", "Alder Quartz 40 Fund", "Alder Mutual Fund", "Direct")], "scheme_code STRING, name STRING, amc STRING, plan_type STRING")
    records = spark.createDataFrame([("ALDER  mutual-fund", 1, "Alder Harvest Fund", "1.9", "0.6", "2027-02-01"),
                                     ("Alder Mutual Fund", 2, "Alder Quartz 40 Fund", "1.5", "44", "2027-02-01"),
                                     ("Alder Mutual Fund", 3, "Alder Vanished Fund", "1.5", "1", "2027-02-01"),
                                     ("Nobody Mutual Fund", 4, "Alder Harvest Fund", "1", "1", "2027-02-01")], TER)
    got = {k: v["ter"] for k, v in rows_of(costs.ter_rows(records, schemes, "2027-02-01"), "scheme_code").items()}
    assert got == {"H1": 0.6, "H2": 1.9}
    assert [r.mf_name for r in costs.unmapped_houses(records, schemes).collect()] == ["Nobody Mutual Fund"]
    assert [tuple(r) for r in costs.ter_unmatched(records, schemes).collect()] == [("Alder Mutual Fund", 1)]


def test_cost_rows_keep_their_other_columns(spark):
    day, later = D(2027, 2, 1), D(2027, 3, 1)
    stored = spark.createDataFrame([("A", day, 1.0, "1% in a year", 500.0), ("B", day, 2.0, None, 100.0)], schemas.SCHEME_COSTS)
    feed = spark.createDataFrame([("A", day, 0.9), ("A", later, 0.8)], "scheme_code STRING, as_of_date DATE, ter DOUBLE")
    got = sorted(tuple(r) for r in costs.upserted(stored, feed).collect())
    assert got == [("A", day, 0.9, "1% in a year", 500.0), ("A", later, 0.8, None, None), ("B", day, 2.0, None, 100.0)]


def test_fund_sizes(spark):
    assert column(spark, feeds.lakh_to_crore, "123456.7", "250", "0", None, "n/a") == [1234.57, 2.5, None, None, None]
    assert column(spark, feeds.period_end, "October - December 2024", "May 2023", "January - March 2025", "", "nothing", "Feb 2024") == \
        [D(2024, 12, 31), D(2023, 5, 31), D(2025, 3, 31), None, None, None]
    field = "ExcludingFundOfFundsDomesticButIncludingFundOfFundsOverseas"

    def entry(code, **sizes):
        return {"SchemeNAVName": "n", "AMFI_Code": code, "AverageAumForTheMonth": sizes}

    doc = [{"ordinal": 7, "Mfname": "X", "SchemeCat_Desc": "Y", "schemes": [entry(11, **{field: 800.0, "FundOfFundsDomestic": 0}), entry(12, **{field: 0}),
                                                                             entry(13, **{field: 0, "FundOfFundsDomestic": 450.55}), entry(None, **{field: 5})]},
           {"ordinal": 3, "Mfname": "X", "SchemeCat_Desc": "Y", "schemes": [entry(11, **{field: 90_000.0}), entry(13, **{field: 70_000.0})]}]
    groups = spark.createDataFrame([(json.dumps(g),) for g in doc], "v STRING").select(F.from_json("v", schemas.AUM_GROUPS).alias("g")).select("g.*")
    assert sorted((r.scheme_code, r.aaum_cr) for r in costs.aum_rows(groups).collect()) == [("11", 8.0), ("11", 900.0), ("13", 4.51), ("13", 700.0)]
    known = spark.createDataFrame([("11",), ("13",)], "scheme_code STRING")
    assert {r.scheme_code: r.aaum_cr for r in costs.known_aum(groups, known, "2027-03-31").collect()} == {"11": 8.0, "13": 4.51}  # the feed's last


def test_link_dates(spark):
    assert column(spark, feeds.link_date, "x/30th-September-2025.xlsx", "x/30 June 2026.xls", "x/31-May-26.xlsx", "x/December-31,-2025.xlsx",
                  "x/June 30 2026.xls", "x/undated.xlsx", "x/31-feb-2026.xlsx") == \
        [D(2025, 9, 30), D(2026, 6, 30), D(2026, 5, 31), D(2025, 12, 31), D(2026, 6, 30), None, None]


# --- names ---------------------------------------------------------------------------------------

ALDER = [("h1", "Alder Harvest Fund - Direct Plan - Growth"), ("h2", "Alder Harvest Fund - Regular Plan - Growth"), ("h3", "Alder Harvest Fund - Direct Plan - IDCW"),
         ("q1", "Alder Quartz 40 Fund - Direct Plan - Growth"), ("s1", "Alder Small-Town Lenders Fund - Direct Plan - Growth")]
MAPLE = [("r1", "Maple Pension Fund - Bold Plan - Direct Plan - Growth"), ("r2", "Maple Pension Fund - Bold Mixed Plan - Direct Plan - Growth"),
         ("r3", "Maple Pension Fund - Careful Plan - Direct Plan - Growth"), ("o1", "Maple Oil & Gas Fund - Direct Plan - Growth"),
         ("o2", "Maple Oil & Gas Fund - Regular Plan - Growth")]
BIRCH = [("i1", "Birch Reserve Fund - Direct Plan - Growth"), ("i2", "Birch Reserve Fund - Regular Plan - Growth"), ("i3", "Birch Regular Reserve Fund - Direct Plan - Growth")]


def matches(spark, identity, house, funds, *titles):
    table = spark.createDataFrame([(house, c, n) for c, n in funds], "amc STRING, scheme_code STRING, name STRING")
    wanted = spark.createDataFrame([(house, t) for t in titles], "amc STRING, title STRING").withColumn("target", identity(F.col("title")))
    codes = resolve.resolve_codes(wanted, table)
    found = {}
    for r in wanted.join(codes, ["amc", "target"], "left").collect():
        found.setdefault(r.title, set()).update({r.scheme_code} - {None})
    return found


def test_titles_find_every_code_of_their_fund(spark):
    harvest = {"h1", "h2", "h3"}
    assert matches(spark, names.master_identity, "a", ALDER, "Alder Harvest Fund", "Alder Harvest Fund - Half-Yearly Statement (Draft)", "Alder Quartz 40 Fund",
                   "Alder Small Town Lenders Fund", "Alder", "Alder Fund", "Alder Winter Wheat Fund") == {
        "Alder Harvest Fund": harvest, "Alder Harvest Fund - Half-Yearly Statement (Draft)": harvest, "Alder Quartz 40 Fund": {"q1"},
        "Alder Small Town Lenders Fund": {"s1"}, "Alder": set(), "Alder Fund": set(), "Alder Winter Wheat Fund": set()}


def test_a_short_title_must_fit_one_fund(spark):
    funds = [*ALDER, ("h9", "Alder Harvest Two Fund - Direct Plan - Growth"), ("h8", "Alder Hay Fund - Direct Plan - Growth"), ("h7", "Alder Hay Bale Fund - Direct Plan - Growth")]
    assert matches(spark, names.master_identity, "a", funds, "Alder Harvest Fund", "Alder Quartz", "Alder Ha") == {
        "Alder Harvest Fund": {"h1", "h2", "h3"}, "Alder Quartz": {"q1"}, "Alder Ha": set()}


def test_a_plan_word_may_belong_to_the_name(spark):
    assert matches(spark, names.sheet_identity, "b", BIRCH, "Birch Reserve Fund", "Birch Regular Reserve Fund") == {
        "Birch Reserve Fund": {"i1", "i2"}, "Birch Regular Reserve Fund": {"i3"}}


def test_the_longest_name_wins_and_and_is_ampersand(spark):
    assert matches(spark, names.sheet_identity, "m", MAPLE, "MAPLE PENSION FUND - BOLD MIXED PLAN", "MAPLE PENSION FUND - CAREFUL PLAN") == {
        "MAPLE PENSION FUND - BOLD MIXED PLAN": {"r2"}, "MAPLE PENSION FUND - CAREFUL PLAN": {"r3"}}
    assert matches(spark, names.master_identity, "m", MAPLE, "Maple Oil And Gas Fund") == {"Maple Oil And Gas Fund": {"o1", "o2"}}


# --- sheets ----------------------------------------------------------------------------------------

def cells_of(spark, **grids):
    rows = []
    for sheet, grid in grids.items():
        for i, line in enumerate(grid, 1):
            for j, v in enumerate(line):
                if v is not None:
                    number = float(v) if isinstance(v, (int, float)) else None
                    rows.append(("f", sheet, i, j, str(v), number, v if isinstance(v, dt.date) else None))
    return spark.createDataFrame(rows, schemas.CELLS)


# a code in the first column, ISIN before the name, weights as fractions
CODED = [["QX-77", "ALDER TIMBER FUND (A Scheme of Trees)"], [None, "Monthly Portfolio Statement as on March 31,2027"], [None],
         [None, "ISIN", "Name of the Instrument", "Industry / Rating", "Quantity", "Market/Fair Value ( Rs. in Lacs)", "% to NAV"],
         [None, "Shares"], ["LN-9", "QQ0000000017", "Pine Saws Limited", "Wood & Paper", 120, 4321.5, 0.25],
         ["LN-3", "QQ0000000025", "Oak Beams Limited", "Wood & Paper", 80, 1200.0, 0.0725],
         [None, "Sub Total", None, None, None, None, 0.3225], [None, "Cash", None, None, None, None, 0.01]]
# label and date cell, weights in percent
LABELLED = [["Maple Mutual Fund", "12"], ["SCHEME NAME :", "Maple Oil And Gas Fund"], ["PORTFOLIO STATEMENT AS ON", D(2027, 3, 31)], [None],
            [None, None, "Name of the Instrument / Issuer", "ISIN", "Rating / Industry^", "Quantity", "Market value (Rs. in Lakhs)", "% to AUM"],
            [None, None, "SHARES"], [None, None, "Deep Well Ltd.", "QQ0000000033", "Drilling", 10, 2500.0, 41.5],
            [None, None, "Pipe Works Ltd.", "QQ0000000041", "Drilling", 9, 900.0, 12.25],
            [None, None, "Sunk", "QQ0000000058", "Drilling", 9, None, 512], [None, None, "No weight", "QQ0000000066", None, 9, None, None]]
# title text, names beside the ISIN and not under their label
SHIFTED = [[None, None, "Portfolio of Birch Wireless Fund as on 31-Mar-2027"],
           ["Name of Instrument", None, None, "ISIN Code", "Industry", "Yield", "Quantity", "Market Value (Rs.in Lacs)", "% to Net Assets"],
           ["Shares"], [None, " ", "MAST AND CABLE LTD.", "QQ0000000074", "Towers", None, 7, 777.0, 33.0], [None, " ", "Signal Ltd.", "QQ0000000082", "Towers", None, 5, 500.0, 20.0]]
LATER = [["Scheme Name: Birch Long Bond Fund", D(2044, 1, 1)], ["Birch Mutual Fund"],
         ["Name of the Instrument", "ISIN", "Rating", "Maturity", "% to Net Assets"], ["State 2044", "QQ0000000090", "SOV", D(2020, 1, 1), 70.0],
         ["State 2045", "QQ0000000108", "SOV", D(2020, 1, 1), 55.0]]
NO_HEADER = [["Scheme Name: Lost Fund"], ["ISIN", "Quantity"], ["QQ0000000017", 5]]
NO_WEIGHTS = [["Scheme Name: Blind Fund"], ["Name of the Instrument", "ISIN", "Quantity"], ["Pine Saws Limited", "QQ0000000017", 5]]
DEEP = [["Scheme Name: Maple Deep Fund"], *([f"note {i}"] for i in range(40)), ["as on 28 February 2027"],
        ["Name of the Instrument", "ISIN", "% to NAV"], ["Pine Saws Limited", "QQ0000000017", 88.0]]


@pytest.fixture(scope="module")
def cells(spark):
    return cells_of(spark, coded=CODED, labelled=LABELLED, shifted=SHIFTED, later=LATER, none=NO_HEADER, blind=NO_WEIGHTS, deep=DEEP)


@pytest.fixture(scope="module")
def parsed(cells):
    titles, lines = sheets.parse_sheets(cells, "2027-04-15")
    return titles, rows_of(titles, "sheet"), rows_of(lines, "sheet", "isin")


def test_titles_above_the_header(parsed):
    _, titles, _ = parsed
    assert titles["coded"]["scheme_name"].startswith("ALDER TIMBER FUND")
    assert titles["labelled"]["scheme_name"] == "Maple Oil And Gas Fund" and titles["shifted"]["scheme_name"] == "Birch Wireless Fund"
    assert {titles[s]["as_of_date"] for s in ("coded", "labelled", "shifted")} == {D(2027, 3, 31)}
    # a date after today is no statement date, and dates below the header are not looked at
    assert (titles["later"]["scheme_name"], titles["later"]["as_of_date"]) == ("Birch Long Bond Fund", D(2027, 4, 15))
    assert (titles["deep"]["scheme_name"], titles["deep"]["as_of_date"]) == ("Maple Deep Fund", D(2027, 2, 28))
    assert set(titles) == {"coded", "labelled", "shifted", "later", "deep"}


def test_sheets_that_cannot_be_read_are_listed(cells):
    assert {r.sheet: r.reason for r in sheets.unreadable(cells).collect()} == {"none": "no header row", "blind": "header lacks a column"}
    assert {r.sheet for r in sheets.unreadable(cells, header_scan_rows=25).collect()} == {"none", "blind", "deep"}


def test_a_date_cell_needs_no_text(spark):
    def read(text):
        rows = [("f", "s", 1, 0, "Scheme Name: Dated Fund", None, None), ("f", "s", 2, 0, text, None, D(2027, 3, 31)), ("f", "s", 3, 0, "Name of the Instrument", None, None),
                ("f", "s", 3, 1, "ISIN", None, None), ("f", "s", 3, 2, "% to NAV", None, None), ("f", "s", 4, 0, "Pine Saws", None, None),
                ("f", "s", 4, 1, "QQ0000000017", None, None), ("f", "s", 4, 2, "50", 50.0, None)]
        return sheets.parse_sheets(spark.createDataFrame(rows, schemas.CELLS), "2027-04-15")[0].first().as_of_date
    assert read("2027-03-31") == read("") == read(None) == D(2027, 3, 31)


def test_lines_below_the_header(parsed):
    _, titles, lines = parsed
    pine = lines["coded", "QQ0000000017"]
    assert (pine["instrument_name"], pine["sector"], pine["pct_of_aum"], pine["market_value_cr"]) == ("Pine Saws Limited", "Wood & Paper", 25.0, 43.22)
    assert titles["coded"]["lines"] == 2 and lines["labelled", "QQ0000000033"]["pct_of_aum"] == 41.5
    # junk weights are dropped without flipping the scale, missing ones are 0
    assert ("labelled", "QQ0000000058") not in lines and lines["labelled", "QQ0000000066"]["pct_of_aum"] == 0.0
    assert lines["labelled", "QQ0000000066"]["sector"] == "Cash & Equivalents"
    assert lines["shifted", "QQ0000000074"]["instrument_name"] == "MAST AND CABLE LTD." and lines["shifted", "QQ0000000074"]["pct_of_aum"] == 33.0
    assert lines["later", "QQ0000000090"]["sector"] == "Debt / Money Market"


def test_heavy_sheets_are_held_back(spark, parsed):
    titles, _, _ = parsed
    assert [r.sheet for r in sheets.suspect(titles).collect()] == ["later"]
    houses = spark.createDataFrame([("f", "Maple Mutual Fund")], "file STRING, amc STRING")
    schemes = spark.createDataFrame([("Maple Mutual Fund", c, n) for c, n in MAPLE], "amc STRING, scheme_code STRING, name STRING")
    matched = holdings.matched_sheets(titles, houses, schemes)
    assert {(r.sheet, r.scheme_code) for r in matched.collect()} == {("labelled", "o1"), ("labelled", "o2")}
    report = holdings.load_report(titles, houses, schemes).collect()[0]
    assert (report.sheets, report.suspect, report.matched, report.unmatched) == (5, 1, 1, 3)


def test_every_landed_sheet_is_loaded_or_has_a_reason(spark, parsed):
    empty = [["Scheme Name: Maple Empty Fund"], ["Name of the Instrument", "ISIN", "% to NAV"], ["Total", "", 100.0]]
    old = [["Scheme Name: Maple Oil And Gas Fund"], ["as on 31 March 2027"], ["Name of the Instrument", "ISIN", "% to NAV"], ["Pine Saws Limited", "QQ0000000017", 88.0]]
    elsewhere = cells_of(spark, away=DEEP).withColumn("file", F.lit("g"))
    landed = cells_of(spark, coded=CODED, labelled=LABELLED, later=LATER, none=NO_HEADER, blind=NO_WEIGHTS, empty=empty, a_copy=old).unionByName(elsewhere)
    houses = spark.createDataFrame([("f", "Maple Mutual Fund")], "file STRING, amc STRING")
    schemes = spark.createDataFrame([("Maple Mutual Fund", c, n) for c, n in MAPLE], "amc STRING, scheme_code STRING, name STRING")
    load = holdings.load_sheets(landed, houses, schemes, "2027-04-15")
    held = {r.sheet: r.reason for r in load.quarantine.collect()}
    assert held == {"none": "no header row", "blind": "header lacks a column", "empty": "no valid line", "later": "suspect weights", "coded": "no such fund",
                    "a_copy": "superseded", "away": "unknown house"}
    assert load.counts["landed"] == 8 and load.counts["loaded"] == 1 and sum(load.counts[r] for r in holdings.REASONS) == 7
    assert {r.scheme_code for r in load.rows.collect()} == {"o1", "o2"} and load.rows.filter("isin = 'QQ0000000033'").first().pct_of_aum == 41.5
    nothing = holdings.load_sheets(landed.limit(0), houses, schemes, "2027-04-15")
    assert nothing.counts["landed"] == 0 and nothing.quarantine.count() == 0 and nothing.rows.count() == 0


def test_dates_in_words(spark):
    assert set(column(spark, feeds.as_on_date, "as on March 31, 2027", "AS ON March 31,2027", "as on 31-Mar-2027", "Statement as at 31 March 2027")) == {D(2027, 3, 31)}
    # only whole month words count
    assert column(spark, feeds.as_on_date, "as on Market 30, 2026", "as on Junction 5, 2026", "as on Sept 5, 2026", "as on Decem 5, 2026") == [None, None, D(2026, 9, 5), None]


def test_constants_that_define_results():
    assert K.ISIN_PATTERN == "^[A-Z]{2}[A-Z0-9]{9}[0-9]$" and K.JUMP_LIMIT == 0.40 and K.STALE_AFTER_DAYS == 45
    assert K.JOIN_WORDS == ["and", "the"] and K.MAX_PORTFOLIO_WEIGHT == 115.0 and K.MIN_RISK_POINTS == 150 and K.MIN_ROLLING_WINDOWS == 30


# --- registered queries over landed input ---------------------------------------------------

@pytest.fixture()
def small_tables(spark, tmp_path):
    """A data folder of sales and parts."""
    rng = random.Random(21)
    parts = [(p, f"Brand#{11 + p % 5}", f"part {p}", "STEEL", p % 50 + 1, 900.0 + p) for p in range(1, 21)]
    sales = [(o, n, rng.randrange(1, 25), rng.randrange(1, 4), rng.choice("OF"), rng.choice("ANR"), dt.datetime(2001, rng.randrange(1, 11), rng.randrange(1, 29)),
              rng.randrange(11) / 100, 1000.0 + o) for o in range(1, 200) for n in range(1, 4)]
    spark.createDataFrame(parts, "p_partkey BIGINT, p_brand STRING, p_name STRING, p_type STRING, p_size INT, p_retailprice DOUBLE").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(sales, "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_linestatus STRING, l_returnflag STRING, "
                          "l_shipdate TIMESTAMP, l_discount DOUBLE, l_extendedprice DOUBLE").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["price_store", "pinned_prices"])
def test_prices_are_derived_once(spark, small_tables, monkeypatch, name):
    """However often a store is corrected, the series behind it are built in one job."""
    nav = queries.Tables(spark, small_tables).nav.collect()
    settled, settle = [], queries.settle
    monkeypatch.setattr(queries, "settle", lambda df, label: settled.append(label) or settle(df, label))
    rows = queries.REGISTRY[name](spark, small_tables)
    assert settled == ["nav"]
    stored = {(r.scheme_code, r.date): r.nav for r in rows.collect()}
    if name == "pinned_prices":
        assert stored == {(r.scheme_code, r.date): r.nav for r in nav}
    else:
        corrected = {(r.scheme_code, r.date) for r in nav if r.date >= dt.date(2001, 8, 1)}
        assert all(stored[r.scheme_code, r.date] == pytest.approx(r.nav * (2 if (r.scheme_code, r.date) in corrected else 1)) for r in nav)


@pytest.mark.parametrize("name", ["set_overlaps", "overlap_pairs"])
def test_overlaps_store_no_text(spark, small_tables, monkeypatch, name):
    """Weights are all that an overlap reads of the holdings."""
    stored, settle = {}, queries.settle
    monkeypatch.setattr(queries, "settle", lambda df, label: stored.setdefault(label, df.columns) and settle(df, label))
    rows = queries.REGISTRY[name](spark, small_tables).collect()
    assert stored["holdings"] == ["scheme_code", "as_of_date", "isin", "pct_of_aum"]
    assert rows and all(r.a < r.b and r.common_count is not None for r in rows)


def test_size_feed_lands_compressed(spark, small_tables):
    groups = queries._size_groups(queries.Tables(spark, small_tables))
    assert all(f.endswith(".json.gz") for f in groups.inputFiles()) and groups.count() == 199 * 3
    codes = {r.scheme_code for r in queries.REGISTRY["aum_load"](spark, small_tables).collect()}
    assert codes and codes <= {str(p) for p in range(1, 21)}
    unknown = {r.scheme_code for r in queries.REGISTRY["aum_unknown"](spark, small_tables).collect()}
    assert "24" in unknown and not unknown & codes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_sheet_lie_together(spark, cells):
    """Cells move to their sheets once at most; totals and whatever asks for a sheet's lines find them there."""
    lines = sheets.parse_sheets(cells, "2027-04-15")[1]
    assert "Exchange" not in plan_of(lines) and lines.count() == 2 + 3 + 2 + 2 + 1
    landed = session.settle_by(cells.repartition(4, "file", "sheet"), "cells", "file", "sheet", buckets=4, placed=True)
    assert len(landed.inputFiles()) <= 4 and sorted(map(str, landed.collect())) == sorted(map(str, cells.collect()))
    columns = sheets.column_map(landed, sheets.header_rows(landed)).localCheckpoint()
    assert plan_of(sheets.sheet_lines(landed, columns)).count("Exchange") == 1  # the few sheets move, cells don't


def test_rows_of_cells_that_come_twice_or_are_odd(spark):
    """A name beside the ISIN counts if it is one and no industry; cells may come twice, without text or number."""
    def cell(row, col, text, num=None):
        return ("f", "s", row, col, text, num, None)
    head = [cell(2, 1, "Name of Instrument"), cell(2, 3, "ISIN"), cell(2, 4, "Industry"), cell(2, 6, "Market value"), cell(2, 8, "% to NAV")]
    rows = [cell(3, 2, "42"), cell(3, 3, " QQ0000000017 "), cell(3, 4, "Timber"), cell(3, 8, "1.5"), cell(3, 8, "2.5", 2.5), cell(4, 2, " Oak Beams "), cell(4, 2, "Ash"),
            cell(4, 3, "QQ0000000025"), cell(4, 3, "QQ0000000025"), cell(4, 4, "  "), cell(4, 6, None, 7.0), cell(4, 8, "junk"), cell(5, 1, "Elm"), cell(5, 2, "QQ0000000074"),
            cell(5, 3, "QQ0000000033"), cell(5, 4, None), cell(5, 8, " 3 "), cell(6, 1, "Total"), cell(6, 3, "none"), cell(6, 8, "9")]
    cells = spark.createDataFrame(head + rows, schemas.CELLS)
    found = sheets.sheet_lines(cells, sheets.column_map(cells, sheets.header_rows(cells)))
    assert sorted(tuple(r) for r in found.collect()) == [("f", "s", 4, "Oak Beams", "QQ0000000025", None, None, 7.0), ("f", "s", 5, "Elm", "QQ0000000033", None, 3.0, None)]


@pytest.fixture()
def traded(spark, tmp_path):
    """A data folder of sales by ten suppliers."""
    parts = [(p, f"Brand#{11 + p % 5}", f"part {p}", "STEEL", p % 50 + 1, 900.0 + p) for p in range(1, 21)]
    sales = [(o, n, (o * 7 + n) % 20 + 1, o % 10, dt.datetime(2000 + o % 2, 1 + o % 11, 1 + o % 28), 1000.0 + o) for o in range(200) for n in range(1, 4)]
    spark.createDataFrame(parts, "p_partkey BIGINT, p_brand STRING, p_name STRING, p_type STRING, p_size INT, p_retailprice DOUBLE").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(s, f"Supplier#{s}") for s in range(10)], "s_suppkey BIGINT, s_name STRING").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(sales, "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_shipdate TIMESTAMP, l_extendedprice DOUBLE").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["sheet_report", "sheet_suspects", "sheet_quarantine", "sheet_holdings", "sheet_sectors"])
def test_sheets_land_once_from_portfolios_derived_once(spark, traded, monkeypatch, name):
    written, settle, settle_by = [], queries.settle, queries.settle_by
    monkeypatch.setattr(queries, "settle", lambda df, label: written.append((label, df.columns)) or settle(df, label))
    monkeypatch.setattr(queries, "settle_by", lambda df, label, *keys, **how: written.append((label, df.columns, keys)) or settle_by(df, label, *keys, **how))
    rows = queries.REGISTRY[name](spark, traded).collect()
    labels = [w[0] for w in written]
    assert labels.count("holdings") == labels.count("cells") == 1 and "all-cells" not in labels
    assert next(w[2] for w in written if w[0] == "cells") == ("file", "sheet")
    if name == "sheet_report":
        assert {r.amc: (r.sheets, r.suspect, r.matched, r.unmatched) for r in rows} == {"Alder Mutual Fund": (4, 1, 3, 0), "Birch Mutual Fund": (3, 0, 2, 1), "Cedar Mutual Fund": (3, 0, 3, 0)}
    elif name == "sheet_suspects":
        assert [(r.sheet, round(r.total_pct)) for r in rows] == [("S9", 125)]
    elif name == "sheet_quarantine":
        assert {r.sheet: r.reason for r in rows} == {"S9": "suspect weights", "S4": "no such fund", "S2-note": "no header row", "S3-note": "header lacks a column", "S5-note": "no valid line"}
    else:
        assert {r.scheme_code for r in rows} == {f"S{s}" for s in (0, 1, 2, 3, 5, 6, 7, 8)}
