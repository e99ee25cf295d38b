"""Model tables derived from the driver's tables.

Each view is one SQL text that Spark and DuckDB both accept, so a query and its
oracle start from equal rows. Sums run over integers (discount points, cents,
scaled logs), which makes the derived values independent of addition order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-11-05"  # the day after the last ship date
SHEETS_READ_ON = "2001-12-31"  # sheets are dated by month end

BASE_TABLES = ("customer", "supplier", "part", "lineitem")


def rnd(expr: str, digits: int) -> str:
    """SQL twin of navloom.functions.rounding.rnd."""
    return f"(round(({expr}) + sign({expr}) * 1e-9, {digits}) + 0e0)"


_CATEGORY = """CASE {n} % 5 WHEN 0 THEN 'Equity Scheme - Large Cap Fund'
    WHEN 1 THEN 'Equity Scheme - Mid Cap Fund' WHEN 2 THEN 'Equity Scheme - Small Cap Fund'
    WHEN 3 THEN 'Equity Scheme - Flexi Cap Fund' ELSE 'Debt Scheme - Liquid Fund' END"""
_HOUSE = "CASE {n} % 3 WHEN 0 THEN 'Alder' WHEN 1 THEN 'Birch' ELSE 'Cedar' END"


def _brand_rows() -> str:
    return f"""
  SELECT b || CASE WHEN v < 2 THEN '-O' ELSE '-F' END || CASE WHEN v % 2 = 0 THEN '' ELSE '-IDCW' END AS scheme_code,
         {_HOUSE.format(n="n")} || ' ' || b || ' Fund - ' || CASE WHEN v < 2 THEN 'Direct' ELSE 'Regular' END || ' Plan - ' ||
           CASE WHEN v % 2 = 0 THEN 'Growth' ELSE 'IDCW' END AS name,
         {_HOUSE.format(n="n")} || ' Mutual Fund' AS amc, {_CATEGORY.format(n="n")} AS category,
         CASE WHEN v < 2 THEN 'Direct' ELSE 'Regular' END AS plan_type, CASE WHEN v % 2 = 0 THEN 'Growth' ELSE 'IDCW' END AS option_type,
         'G' || CAST(n AS STRING) AS fund_group_id, CASE WHEN v % 2 = 0 THEN 'done' END AS backfill_status
  FROM (SELECT DISTINCT p_brand AS b, CAST(substr(p_brand, 7) AS INT) AS n, p_partkey % 4 AS v FROM part) brands"""


def _proxy_rows() -> str:
    names = (("120716", "Market Nifty 50 Index"), ("147625", "Market Nifty 500 Index"),
             ("147622", "Market Nifty Midcap 150 Index"), ("147623", "Market Nifty Smallcap 250 Index"))
    return " UNION ALL ".join(f"""
  SELECT '{code}', '{name} Fund - Direct Plan - Growth', 'Alder Mutual Fund', 'Other Scheme - Index Funds',
         'Direct', 'Growth', 'P{code}', 'done'""" for code, name in names)


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # daily prices: one series per (brand, line status), per supplier and per
    # proxy (return flag, whole market); one row per series and ship day
    "fx_nav": ((), """
SELECT scheme_code, d AS date,
       round(100e0 * exp(CAST(sum(lr) OVER (PARTITION BY scheme_code ORDER BY d
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 1e12), 4) AS nav
FROM (
  SELECT scheme_code, d, CAST(round(ln(1e0 + CASE
           WHEN num % 10 = 7 AND o % 194 = 0 THEN 0.8e0
           WHEN num % 10 = 7 AND o % 194 = 97 THEN -0.4444e0
           ELSE (sx / (n * 1e2) - 5e-2) / 2e0 + 4e-4 + bonus END) * 1e12) AS BIGINT) AS lr
  FROM (
    SELECT d, sx, n, o,
           CASE WHEN gb = 0 THEN b || '-' || s WHEN gk = 0 THEN 'S' || CAST(k AS STRING)
                WHEN gf = 0 THEN CASE f WHEN 'A' THEN '147622' WHEN 'N' THEN '147625' ELSE '147623' END
                ELSE '120716' END AS scheme_code,
           CASE WHEN gb = 0 THEN CAST(substr(b, 7) AS BIGINT) WHEN gk = 0 THEN k ELSE CAST(0 AS BIGINT) END AS num,
           CASE WHEN gb = 0 AND s = 'O' THEN 4e-5 ELSE 0e0 END AS bonus
    FROM (
      SELECT b, s, k, f, d, grouping(b) AS gb, grouping(k) AS gk, grouping(f) AS gf,
             CAST(sum(x) AS DOUBLE) AS sx, CAST(count(*) AS DOUBLE) AS n, max(o) AS o
      FROM (SELECT l_suppkey AS k, l_linestatus AS s, l_returnflag AS f, p_brand AS b,
                   CAST(l_shipdate AS DATE) AS d, CAST(round(l_discount * 100) AS BIGINT) AS x, l_orderkey AS o
            FROM lineitem JOIN part ON l_partkey = p_partkey) li
      GROUP BY GROUPING SETS ((b, s, d), (k, d), (f, d), (d))) g) r) steps"""),
    "fx_master": ((), f"""
SELECT scheme_code, name, amc, category, plan_type, option_type, fund_group_id, backfill_status, TRUE AS is_active
FROM ({_brand_rows()} UNION ALL
  SELECT 'S' || CAST(s_suppkey AS STRING), {_HOUSE.format(n="s_suppkey")} || ' ' || s_name || ' Fund - Regular Plan - Growth',
         {_HOUSE.format(n="s_suppkey")} || ' Mutual Fund', {_CATEGORY.format(n="s_suppkey")},
         'Regular', 'Growth', 'GS' || CAST(s_suppkey AS STRING), 'done'
  FROM supplier UNION ALL {_proxy_rows()}) m"""),
    # yearly portfolios: supplier = fund, part = instrument, 95% invested
    "fx_holdings": ((), f"""
SELECT 'S' || CAST(v.k AS STRING) AS scheme_code, last_day(t.d) AS as_of_date, p_name AS instrument_name,
       'IN' || CASE WHEN v.p < 10000000000 THEN lpad(CAST(v.p AS STRING), 10, '0') ELSE CAST(v.p AS STRING) END AS isin,
       p_type AS sector, {rnd("95e0 * v.v / t.v", 4)} AS pct_of_aum, {rnd("v.v / 1e5", 2)} AS market_value_cr
FROM (SELECT l_suppkey AS k, year(l_shipdate) AS y, l_partkey AS p,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS v
      FROM lineitem GROUP BY l_suppkey, year(l_shipdate), l_partkey) v
JOIN (SELECT l_suppkey AS k, year(l_shipdate) AS y, max(CAST(l_shipdate AS DATE)) AS d,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS v
      FROM lineitem GROUP BY l_suppkey, year(l_shipdate)) t ON v.k = t.k AND v.y = t.y
JOIN part ON v.p = p_partkey"""),
    # monthly expense ratios per plan, Direct at 60% of Regular
    "fx_costs": ((), f"""
SELECT scheme_code, as_of_date, {rnd("CASE WHEN direct = 1 THEN 15e-2 ELSE 25e-2 END * t / n", 4)} AS ter
FROM (SELECT p_brand || '-' || l_linestatus AS scheme_code,
             make_date(CAST(year(l_shipdate) AS INT), CAST(month(l_shipdate) AS INT), 1) AS as_of_date,
             max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS direct,
             CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS n
      FROM lineitem JOIN part ON l_partkey = p_partkey
      GROUP BY p_brand || '-' || l_linestatus, make_date(CAST(year(l_shipdate) AS INT), CAST(month(l_shipdate) AS INT), 1)) c"""),
    # quarterly average size per fund
    "fx_aum": ((), f"""
SELECT scheme_code, as_of_date, {rnd("v / 1e7", 2)} AS aaum_cr
FROM (SELECT 'S' || CAST(l_suppkey AS STRING) AS scheme_code,
             last_day(make_date(CAST(year(l_shipdate) AS INT), CAST(quarter(l_shipdate) AS INT) * 3, 1)) AS as_of_date,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS v
      FROM lineitem GROUP BY l_suppkey, last_day(make_date(CAST(year(l_shipdate) AS INT), CAST(quarter(l_shipdate) AS INT) * 3, 1))) a"""),
    # one investor plan per customer; starts run from before the first price to after the last
    "fx_plans": ((), """
SELECT c_custkey AS plan_id,
       CASE WHEN c_nationkey % 2 = 0 THEN 'S' || CAST(c_custkey % ((SELECT max(s_suppkey) FROM supplier) + 10) AS STRING)
            ELSE 'Brand#' || CAST(c_custkey % 25 + 1 AS STRING) || CASE WHEN c_nationkey % 4 = 1 THEN '-O' ELSE '-F' END END AS scheme_code,
       CAST(1000 + (c_custkey % 20) * 500 AS DOUBLE) AS amount,
       DATE '1994-12-20' + CAST((c_custkey * 37) % 2560 AS INT) AS start_date,
       CASE WHEN c_custkey % 4 = 0 THEN DATE '1994-12-20' + CAST((c_custkey * 37) % 2560 + 900 AS INT) END AS last_instalment,
       CASE WHEN c_custkey % 3 = 0 THEN 'quarterly' ELSE 'monthly' END AS freq,
       CASE WHEN c_custkey % 7 = 0 THEN 20e0 ELSE 30e0 END AS marginal_rate
FROM customer"""),
    # fund sets to compare: the suppliers an order drew on
    "fx_sets": ((), """
SELECT DISTINCT l_orderkey AS set_id, 'S' || CAST(l_suppkey AS STRING) AS scheme_code FROM lineitem"""),
    # projection assumptions per customer
    "fx_scenarios": ((), """
SELECT c_custkey AS scenario_id, CAST(1000 + (c_custkey % 90) * 500 AS DOUBLE) AS amount,
       CAST(1 + c_custkey % 60 AS DOUBLE) / 2e0 AS years, CAST(c_custkey % 29 AS DOUBLE) / 2e0 AS annual_rate,
       CAST(100000 + (c_custkey % 50) * 20000 AS DOUBLE) AS corpus,
       CAST(500 + (c_custkey % 83) * 125 AS DOUBLE) AS monthly_withdrawal
FROM customer"""),
    # part-level scheme catalogue: brand = house, part = fund, growing with the data
    "fx_catalog": ((), f"""
SELECT CAST(p_partkey AS STRING) AS scheme_code,
       p_brand || ' Mutual Fund' AS amc,
       CASE p_partkey % 4 WHEN 0 THEN p_brand || ' ' || p_name || ' ' || CAST(p_size AS STRING) || ' Fund - Direct Plan - Growth'
            WHEN 1 THEN p_brand || ' ' || p_name || ' ' || CAST(p_size AS STRING) || ' Fund - Regular Plan - IDCW (Monthly)'
            WHEN 2 THEN p_brand || ' Regular ' || p_name || ' & ' || lower(p_type) || ' Fund - Regular Plan - Growth'
            ELSE p_brand || ' ' || p_name || ' and the ' || lower(p_type) || ' Fund - Series ' || CAST(p_size AS STRING) || ' - Direct - Dividend Payout' END AS name,
       {_CATEGORY.format(n="p_size")} AS category, p_type, p_size, p_partkey, p_brand, p_name, p_retailprice
FROM part"""),
    "lines_src": (("fx_catalog",), """
SELECT *, 'daily-' || CAST(CAST(floor(p_partkey / 1000e0) AS BIGINT) AS STRING) || '.txt' AS file, CAST(p_size % 5 AS BIGINT) AS c,
       CAST(substr(p_brand, 7) AS BIGINT) AS n, round(p_retailprice) AS cents FROM fx_catalog"""),
    # the landed daily file: sections by category, houses by brand, schemes by part
    "fx_lines": (("lines_src",), """
SELECT file, CAST(floor(pos / 4e12) AS BIGINT) AS block, pos, line
FROM (
  SELECT DISTINCT file, c * 1000000000000000 AS pos, 'Open Ended Schemes ( ' || category || ' )' AS line FROM lines_src
  UNION ALL
  SELECT DISTINCT file, c * 1000000000000000 + n * 1000000000000 + 1, amc FROM lines_src WHERE NOT (c = 3 AND n = 1)
  UNION ALL
  SELECT DISTINCT file, c * 1000000000000000 + n * 1000000000000 + 2,
         'Scheme Code;ISIN Div Payout/ ISIN Growth;ISIN Div Reinvestment;Scheme Name;Net Asset Value;Date' FROM lines_src
  UNION ALL
  SELECT file, c * 1000000000000000 + n * 1000000000000 + 3 + p_partkey,
         scheme_code || ';' || CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE 'INF' || lpad(scheme_code, 9, '0') END || ';' ||
         CASE WHEN p_partkey % 35 = 0 THEN '' ELSE 'INR' || lpad(scheme_code, 9, '0') END || ';' ||
         CASE WHEN p_partkey % 3 = 0
              THEN p_brand || ' ' || p_name || ' Fund;' || CASE WHEN p_size = 19 THEN ';' WHEN p_partkey % 2 = 0
                   THEN 'Direct Plan;Growth' ELSE 'Regular Plan;IDCW-Re-investment' END
              ELSE name END || ';' ||
         CASE WHEN p_size = 13 THEN 'N.A.' ELSE CAST(CAST(cents AS BIGINT) AS STRING) || '.25' END || ';' ||
         CASE WHEN p_size = 17 THEN 'n/a' ELSE lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0') || '-' ||
              substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(1 + 3 * (p_partkey % 12) AS INT), 3) || '-2001' END
  FROM lines_src) t"""),
    # sheet titles to resolve, written four ways
    "fx_targets": (("fx_catalog",), """
SELECT p_partkey, amc, CASE p_partkey % 5
    WHEN 0 THEN p_brand || ' ' || p_name || ' ' || CAST(p_size AS STRING) || ' Fund'
    WHEN 1 THEN p_brand || ' ' || p_name || ' ' || CAST(p_size AS STRING) || ' Fund - Monthly Portfolio (Unaudited)'
    WHEN 2 THEN p_brand || ' Regular ' || p_name || ' and ' || p_type
    WHEN 3 THEN p_brand || ' ' || p_name
    ELSE p_name END AS title
FROM fx_catalog"""),
    # expense-ratio records: one per line item, under house names as a feed writes them
    "fx_ter": ((), """
SELECT CASE WHEN n = 25 THEN 'Delta Mutual Fund' WHEN n % 3 = 0 THEN 'ALDER  Mutual Fund' WHEN n % 3 = 1 THEN 'Birch Mutual-Fund'
            ELSE 'Cedar Mutual Fund' END AS mf_name,
       l_orderkey * 100 + l_linenumber AS ordinal,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN ' '
            ELSE CASE WHEN n = 22 THEN 'Unlisted' WHEN n % 3 = 0 THEN 'Alder' WHEN n % 3 = 1 THEN 'Birch' ELSE 'Cedar' END || ' ' || p_brand ||
                 CASE WHEN n = 24 THEN ' Special' WHEN n % 4 = 0 THEN ' Fund (Open Ended)' ELSE ' Fund' END END AS Scheme_Name,
       CASE t WHEN 0 THEN '0' WHEN 7 THEN 'junk' WHEN 8 THEN '29.6100' ELSE '1.' || CAST(t AS STRING) || '550' END AS R_TER,
       CASE t WHEN 0 THEN '' WHEN 6 THEN '3.01' ELSE '0.' || CAST(t AS STRING) || '300' END AS D_TER,
       CASE WHEN l_linenumber = 6 THEN 'bad' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) || 'T00:00:00Z' END AS TER_Date
FROM (SELECT *, CAST(substr(p_brand, 7) AS INT) AS n, CAST(round(l_tax * 100) AS INT) AS t
      FROM lineitem JOIN part ON l_partkey = p_partkey) l"""),
    # size feed rows: lakh figures, a headline and a fund-of-funds one
    "fx_sizes": ((), """
SELECT l_partkey, CAST(l_partkey AS STRING) AS code, l_orderkey, l_linenumber,
       CASE WHEN l_returnflag = 'R' THEN '0' WHEN l_linenumber = 5 THEN 'junk'
            ELSE CAST(CAST(round(l_extendedprice) AS BIGINT) AS STRING) || '.5' END AS headline,
       CASE WHEN l_linestatus = 'O' THEN CAST(CAST(round(l_extendedprice) AS BIGINT) AS STRING) || '.25' END AS fof
FROM lineitem"""),
    # workbook links of every house, dated in the file name
    "fx_links": ((), """
SELECT CASE l_suppkey % 3 WHEN 0 THEN 'Alder' WHEN 1 THEN 'Birch' ELSE 'Cedar' END || ' Mutual Fund' AS amc,
       'https://files.example.org/p' || CAST(l_suppkey AS STRING) || '/monthly-portfolio-' || CASE l_linenumber % 3
         WHEN 0 THEN CAST(day(l_shipdate) AS STRING) || 'th-' || m || '-' || CAST(year(l_shipdate) AS STRING)
         WHEN 1 THEN m || '-' || CAST(day(l_shipdate) AS STRING) || ',-' || CAST(year(l_shipdate) AS STRING)
         ELSE 'undated' END || '.xlsx' AS url
FROM (SELECT *, CASE month(l_shipdate) WHEN 1 THEN 'January' WHEN 2 THEN 'Feb' WHEN 3 THEN 'March' WHEN 4 THEN 'April'
        WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September'
        WHEN 10 THEN 'Oct' WHEN 11 THEN 'November' ELSE 'December' END AS m FROM lineitem) l"""),
    # compare sets of four: a supplier fund, the twins of a brand, the market
    "fx_compare": ((), """
SELECT s_suppkey AS set_id, 0 AS position, 'S' || CAST(s_suppkey AS STRING) AS scheme_code FROM supplier
UNION ALL SELECT s_suppkey, 1, 'Brand#' || CAST(s_suppkey % 25 + 1 AS STRING) || '-O' FROM supplier
UNION ALL SELECT s_suppkey, 2, 'Brand#' || CAST(s_suppkey % 25 + 1 AS STRING) || '-F' FROM supplier
UNION ALL SELECT s_suppkey, 3, '120716' FROM supplier"""),
    # the stored master and today's file: every part that was sold, but the smallest in the file only and the largest in
    # the master only; a part is listed once for each of its sales
    "fx_master_old": (("fx_catalog",), """
SELECT c.scheme_code, 'Old ' || name AS name, amc, CAST(NULL AS STRING) AS scheme_type, category,
       CAST(NULL AS STRING) AS sub_category, 'Direct' AS plan_type, 'Growth' AS option_type, CAST(NULL AS STRING) AS isin,
       CAST(NULL AS STRING) AS fund_group_id, d1 AS first_seen, d2 AS last_seen, TRUE AS is_active
FROM fx_catalog c JOIN (SELECT l_partkey, min(CAST(l_shipdate AS DATE)) AS d1, max(CAST(l_shipdate AS DATE)) AS d2
                        FROM lineitem GROUP BY l_partkey) l ON p_partkey = l_partkey
WHERE p_size > 2"""),
    "fx_master_new": (("fx_catalog",), """
SELECT scheme_code, d AS nav_date, name, amc, 'Open Ended Schemes' AS scheme_type, category, CAST(NULL AS STRING) AS sub_category,
       'Regular' AS plan_type, 'IDCW' AS option_type, 'INF' || scheme_code AS isin, 'G' || scheme_code AS fund_group_id
FROM fx_catalog c JOIN (SELECT l_partkey, CAST(l_shipdate AS DATE) AS d FROM lineitem) l ON p_partkey = l_partkey
WHERE p_size < 49"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model table as a lazy DataFrame."""
    text = with_ctes((name,), f"SELECT * FROM {name}")
    for table in BASE_TABLES:
        if re.search(rf"\b(FROM|JOIN) {table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(text)


def with_ctes(names: tuple[str, ...], select: str, ctes: dict[str, tuple[tuple[str, ...], str]] | None = None,
              recursive: bool = False) -> str:
    """``select`` behind the CTEs it names, each after those it needs itself."""
    known = {**VIEWS, **(ctes or {})}
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in known[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    body = ",\n".join(f"{n} AS ({known[n][1]})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{select}"
