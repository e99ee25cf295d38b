"""DuckDB SQL for the registered queries, written from the definitions: theta
joins, correlated lookups and plain windows, without the library's shortcuts."""

from __future__ import annotations

from navloom import constants as K
from workload.views import AS_OF, rnd, with_ctes

AS_OF_SQL = f"DATE '{AS_OF}'"


def _values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _words(text: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), "
            "lambda w: w <> '' AND w NOT IN ('and', 'the'))")


_PLAN_WORDS = ", ".join(f"'{w}'" for w in K.PLAN_WORDS)


def _identity(name: str) -> str:
    raw = f"regexp_replace({name}, '\\(.*?\\)', ' ', 'g')"
    cut = r"'(?is)^(.*?)\bfunds?\b(.*)$'"
    tail = f"list_filter({_words(f'regexp_extract({raw}, {cut}, 2)')}, lambda w: w NOT IN ({_PLAN_WORDS}))"
    strip = K.MASTER_STRIP_PATTERN
    return (f"CASE WHEN regexp_matches({raw}, '(?i)\\bfunds?\\b') "
            f"THEN array_to_string(list_concat({_words(f'regexp_extract({raw}, {cut}, 1)')}, {tail}), ' ') "
            f"ELSE array_to_string({_words(f'regexp_replace({raw}, {chr(39)}{strip}{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, ' ') END")


def _sheet_identity(name: str) -> str:
    stripped = f"regexp_replace({name}, '{K.SHEET_STRIP_PATTERN}', ' ', 'g')"
    return f"array_to_string({_words(stripped)}, ' ')"


def _house_key(name: str) -> str:
    return f"trim(replace(regexp_replace(lower({name}), '[^a-z0-9]+', ' ', 'g'), ' mutual fund', ''))"


def _plan(text: str) -> str:
    return (f"CASE WHEN regexp_matches({text}, '(?i)\\bdirect\\b') THEN 'Direct' "
            f"WHEN regexp_matches({text}, '(?i)\\bregular\\b') THEN 'Regular' END")


def _option(text: str) -> str:
    return (f"CASE WHEN regexp_matches({text}, '(?i)\\bidcw\\b|\\bdcw\\b|\\bdividend\\b|income distribution') THEN 'IDCW' "
            f"WHEN regexp_matches({text}, '(?i)\\bgrowth\\b') THEN 'Growth' END")


def _group_id(amc: str, name: str) -> str:
    base = f"regexp_replace(lower({name}), '\\b({K.GROUP_ID_WORDS})\\b', ' ', 'g')"
    return (f"substr(md5(trim(lower(coalesce({amc}, ''))) || '|' || "
            f"regexp_replace({base}, '[^a-z0-9]+', '', 'g')), 1, 16)")


_TAX_CLASS = f"""CASE WHEN regexp_matches(txt, '{'|'.join(K.NON_EQUITY_WORDS)}') THEN
  CASE WHEN regexp_matches(txt, 'index|etf') AND regexp_matches(txt, '{'|'.join(K.EQUITY_INDEX_WORDS)}')
       THEN 'equity' ELSE 'non_equity' END ELSE 'equity' END"""


def _resolution(targets: str, master: str) -> dict:
    """names(amc, identity, codes) and resolved(amc, target, identity, stage)."""
    return {
        "names": ((master,), f"SELECT DISTINCT amc, {_identity('name')} AS identity FROM {master}"),
        "wanted": ((targets,), f"SELECT DISTINCT amc, target FROM {targets}"),
        "long_enough": (("wanted",), "SELECT * FROM wanted WHERE len(string_split(target, ' ')) >= 2"),
        "exact": (("long_enough", "names"), "SELECT t.amc, t.target, n.identity FROM long_enough t JOIN names n ON t.amc = n.amc AND t.target = n.identity"),
        "prefixed": (("long_enough", "names"), """
SELECT t.amc, t.target, arg_max(n.identity, length(n.identity)) AS identity
FROM long_enough t JOIN names n ON t.amc = n.amc AND n.identity <> '' AND starts_with(t.target, n.identity || ' ') GROUP BY ALL"""),
        "reversed": (("long_enough", "names"), """
SELECT t.amc, t.target, min(n.identity) AS identity
FROM long_enough t JOIN names n ON t.amc = n.amc AND starts_with(n.identity, t.target || ' ')
GROUP BY ALL HAVING count(*) = 1"""),
        "resolved": (("wanted", "exact", "prefixed", "reversed"), """
SELECT w.amc, w.target, coalesce(e.identity, p.identity, r.identity) AS identity,
       CASE WHEN e.identity IS NOT NULL THEN 'exact' WHEN p.identity IS NOT NULL THEN 'prefix'
            WHEN r.identity IS NOT NULL THEN 'reverse' END AS stage
FROM wanted w LEFT JOIN exact e USING (amc, target) LEFT JOIN prefixed p USING (amc, target)
LEFT JOIN reversed r USING (amc, target)"""),
    }


_DAILY_RISK = f"""
SELECT *, nav / nullif(prev, 0) - 1 AS ret FROM (
  SELECT scheme_code, date, nav, lag(nav) OVER (PARTITION BY scheme_code ORDER BY date) AS prev
  FROM fx_nav WHERE date >= {AS_OF_SQL} - {K.RISK_DAYS['3Y'] + K.RISK_HISTORY_SLACK_DAYS}) s WHERE prev IS NOT NULL"""

CTES = {
    "proxies": ((), f"SELECT * FROM (VALUES {_values(K.BENCHMARK_PROXIES)}) p(category, proxy, proxy_name, note)"),
    "periods": ((), f"SELECT * FROM (VALUES {_values(K.PERIOD_DAYS.items())}) p(period, days)"),
    # each price with the one before it, found by its place in the series
    "placed": (("fx_nav",), "SELECT *, row_number() OVER (PARTITION BY scheme_code ORDER BY date) AS place FROM fx_nav"),
    "events": (("placed",), f"""
SELECT b.scheme_code, b.date, a.date AS since FROM placed a JOIN placed b ON b.scheme_code = a.scheme_code AND b.place = a.place + 1
WHERE a.nav <> 0 AND (b.nav > a.nav * (1 + {K.JUMP_LIMIT}) OR b.nav < a.nav * (1 - {K.JUMP_LIMIT}))"""),
    "latest": (("fx_nav",), """
SELECT scheme_code, min(date) AS first_date, arg_min(nav, date) AS first_nav, max(date) AS date, arg_max(nav, date) AS nav
FROM fx_nav GROUP BY scheme_code"""),
    "returns": (("latest", "periods", "events", "fx_nav"), f"""
SELECT a.scheme_code, period, {rnd('CASE WHEN days // 365 >= 3 THEN (pow(lnav / anav, 1e0 / (days // 365)) - 1) * 100 ELSE (lnav - anav) / anav * 100 END', 2)} AS ret,
       ldate AS as_of_date
FROM (SELECT l.scheme_code, p.period, p.days, l.date AS ldate, l.nav AS lnav, max(h.date) AS adate, arg_max(h.nav, h.date) AS anav
      FROM latest l CROSS JOIN periods p JOIN fx_nav h ON h.scheme_code = l.scheme_code
       AND h.date <= l.date - p.days AND h.date > l.date - p.days - {K.ANCHOR_TOLERANCE_DAYS}
      GROUP BY ALL) a
LEFT JOIN events e ON e.scheme_code = a.scheme_code AND e.date BETWEEN a.adate + 1 AND a.ldate
WHERE anav > 0 AND e.date IS NULL"""),
    "flags": (("fx_master", "latest", "events"), f"""
SELECT m.scheme_code, CASE WHEN l.date IS NULL OR date_diff('day', l.date, {AS_OF_SQL}) > {K.STALE_AFTER_DAYS} THEN 'stale'
         WHEN m.scheme_code IN (SELECT scheme_code FROM events WHERE date_diff('day', since, {AS_OF_SQL}) <= {K.JUMP_LOOKBACK_DAYS}) THEN 'discontinuity' END AS data_quality
FROM fx_master m LEFT JOIN latest l ON l.scheme_code = m.scheme_code"""),
    "master": (("fx_master", "flags"), "SELECT m.*, f.data_quality FROM fx_master m JOIN flags f USING (scheme_code)"),
    "peers": (("returns", "master"), """
SELECT r.*, m.category FROM returns r JOIN master m USING (scheme_code)
WHERE m.category IS NOT NULL AND m.data_quality IS NULL"""),
    "stats": (("peers",), f"""
SELECT category, period, {rnd('CAST(sum(CAST(round(ret * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 1e2)', 2)} AS avg_return,
       {rnd('percentile_cont(0.5) WITHIN GROUP (ORDER BY ret)', 2)} AS median_return, count(*) AS scheme_count,
       max(as_of_date) AS as_of_date FROM peers GROUP BY category, period"""),
    "ranks": (("peers",), f"""
SELECT scheme_code, period, category, rank() OVER (PARTITION BY category, period ORDER BY ret DESC) AS rank_in_category,
       count(*) OVER (PARTITION BY category, period) AS category_size,
       {rnd('percent_rank() OVER (PARTITION BY category, period ORDER BY ret) * 100', 0)} AS percentile, as_of_date FROM peers"""),
    "daily": (("fx_nav",), _DAILY_RISK),
    "in_window": (("daily",), f"""
SELECT d.*, w.period, max(nav) OVER (PARTITION BY scheme_code, period ORDER BY date) AS peak
FROM daily d JOIN (VALUES {_values(K.RISK_DAYS.items())}) w(period, days) ON d.date >= {AS_OF_SQL} - w.days"""),
    "windows": (("in_window",), f"""
SELECT scheme_code, period, count(*) AS n, stddev_samp(ret) * sqrt(252) * 100 AS stdev,
       (pow(arg_max(nav, date) / arg_min(nav, date), 252e0 / count(*)) - 1) * 100 AS annual, min(nav / peak - 1) * 100 AS dd
FROM in_window GROUP BY scheme_code, period HAVING count(*) >= {K.MIN_RISK_POINTS} AND max(abs(ret)) <= 0.4"""),
    "paired": (("in_window", "fx_master", "proxies", "daily"), """
SELECT f.scheme_code, f.period, p.proxy, count(*) AS pairs, covar_samp(f.ret, b.ret) AS cov, var_samp(b.ret) AS var
FROM in_window f JOIN fx_master m ON m.scheme_code = f.scheme_code JOIN proxies p ON p.category = m.category
JOIN daily b ON b.scheme_code = p.proxy AND b.date = f.date WHERE p.proxy <> f.scheme_code GROUP BY ALL"""),
    "beta": (("windows", "paired"), f"""
SELECT w.scheme_code, w.period, p.cov / p.var AS beta,
       w.annual - (6.5 + p.cov / p.var * (b.annual - 6.5)) AS alpha
FROM windows w JOIN paired p USING (scheme_code, period) JOIN windows b ON b.scheme_code = p.proxy AND b.period = w.period
WHERE p.pairs >= {K.MIN_RISK_POINTS} AND p.pairs >= w.n * {K.MIN_PROXY_COVERAGE} AND p.var > 0"""),
    "risk": (("windows", "beta", "fx_master"), f"""
SELECT w.scheme_code, w.period, {rnd('w.stdev', 2)} AS stdev,
       CASE WHEN w.stdev > 0 THEN {rnd('(w.annual - 6.5) / w.stdev', 2)} END AS sharpe, {rnd('b.beta', 2)} AS beta,
       {rnd('b.alpha', 2)} AS alpha, {rnd('w.dd', 2)} AS max_drawdown, {AS_OF_SQL} AS as_of_date
FROM windows w JOIN fx_master m ON m.scheme_code = w.scheme_code AND m.backfill_status = 'done'
LEFT JOIN beta b ON b.scheme_code = w.scheme_code AND b.period = w.period"""),
    "counted": (("fx_nav",), """
SELECT scheme_code, date, nav, sum(CASE WHEN abs(chg) > 0.4 THEN 1 ELSE 0 END)
         OVER (PARTITION BY scheme_code ORDER BY date ROWS UNBOUNDED PRECEDING) AS jumps
FROM (SELECT *, nav / nullif(lag(nav) OVER (PARTITION BY scheme_code ORDER BY date), 0) - 1 AS chg FROM fx_nav) c"""),
    "starts": (("counted",), f"""
SELECT c.*, w.w, w.days, c.date + w.days AS target
FROM counted c CROSS JOIN (VALUES {_values(K.ROLLING_DAYS.items())}) w(w, days)"""),
    "rolling": (("starts", "counted"), f"""
SELECT s.scheme_code, s.w AS "window", s.date,
       CASE WHEN s.days >= 365 THEN pow(e.nav / s.nav, 1e0 / (date_diff('day', s.date, e.date) / 365e0)) - 1 ELSE e.nav / s.nav - 1 END * 100 AS ret
FROM starts s ASOF JOIN counted e ON s.scheme_code = e.scheme_code AND e.date >= s.target
WHERE e.date <= s.target + {K.WINDOW_END_TOLERANCE_DAYS} AND s.nav > 0 AND e.nav > 0 AND e.jumps = s.jumps"""),
    # portfolios
    "disclosed": (("fx_holdings",), """
SELECT h.* FROM fx_holdings h JOIN (SELECT scheme_code, max(as_of_date) AS d FROM fx_holdings GROUP BY 1) n
  ON h.scheme_code = n.scheme_code AND h.as_of_date = n.d"""),
    "weights": (("disclosed",), """
SELECT scheme_code, as_of_date, isin, sum(pct_of_aum) AS pct, min(instrument_name) AS name FROM disclosed
WHERE isin IS NOT NULL AND isin <> '' AND pct_of_aum IS NOT NULL GROUP BY ALL"""),
    "anchored": (("fx_sets",), """
SELECT s.set_id, f.a, s.scheme_code AS b FROM fx_sets s
JOIN (SELECT set_id, min(scheme_code) AS a FROM fx_sets GROUP BY 1) f ON f.set_id = s.set_id AND f.a < s.scheme_code"""),
    "pairs": (("anchored",), "SELECT DISTINCT a, b FROM anchored"),
    "shared": (("pairs", "weights"), """
SELECT p.a, p.b, wa.isin, wa.name, wa.pct AS pa, wb.pct AS pb, least(wa.pct, wb.pct) AS m
FROM pairs p JOIN weights wa ON wa.scheme_code = p.a JOIN weights wb ON wb.scheme_code = p.b AND wb.isin = wa.isin"""),
    "classes": (("weights",), """
SELECT scheme_code, min(scheme_code) OVER same AS class, count(*) OVER same AS funds
FROM (SELECT scheme_code, list([isin, pct::VARCHAR] ORDER BY isin) AS portfolio FROM weights GROUP BY scheme_code) p WINDOW same AS (PARTITION BY portfolio)"""),
    "exposure": (("fx_sets", "weights"), f"""
SELECT set_id, rank, isin, name, {rnd('pct', 2)} AS pct, held_by FROM (
  SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY round(pct, 9) DESC, isin) AS rank FROM (
    SELECT m.set_id, w.isin, min(w.name) AS name, sum(w.pct) / any_value(l.live) AS pct, count(*) AS held_by
    FROM fx_sets m JOIN weights w USING (scheme_code)
    JOIN (SELECT set_id, count(DISTINCT scheme_code) AS live FROM fx_sets
          WHERE scheme_code IN (SELECT scheme_code FROM weights) GROUP BY 1) l ON l.set_id = m.set_id
    GROUP BY m.set_id, w.isin) g) r WHERE rank <= 10"""),
    # plans
    "validity": (("fx_plans", "fx_master", "latest"), f"""
SELECT plan_id, reason IS NULL AS is_valid, reason, CASE WHEN reason IS NULL THEN {rnd('cagr', 2)} END AS fund_cagr_pct FROM (
  SELECT p.plan_id, CASE WHEN m.scheme_code IS NULL THEN 'unknown scheme' WHEN l.date IS NULL THEN 'no price history'
      WHEN p.start_date < l.first_date THEN 'starts before the fund''s history'
      WHEN p.start_date >= l.date THEN 'starts at or after the latest price' END AS reason,
    (pow(l.nav / l.first_nav, 1 / greatest(date_diff('day', l.first_date, l.date) / 365e0, 1e-9)) - 1) * 100 AS cagr
  FROM fx_plans p LEFT JOIN fx_master m USING (scheme_code) LEFT JOIN latest l USING (scheme_code)) v"""),
    "valid": (("fx_plans", "validity", "latest"), """
SELECT p.*, l.date AS latest_date, l.nav AS latest_nav FROM fx_plans p JOIN latest l USING (scheme_code)
WHERE p.plan_id IN (SELECT plan_id FROM validity WHERE is_valid)"""),
    "due": (("valid",), """
SELECT v.*, k, CASE WHEN k = 0 THEN start_date
   ELSE CAST(date_trunc('month', start_date) + to_months(CAST(k * CASE freq WHEN 'quarterly' THEN 3 ELSE 1 END AS INT)) AS DATE)
        + CAST(least(day(start_date), 28) - 1 AS INT) END AS due
FROM valid v, (SELECT unnest(range(0, 400)) AS k) ks"""),
    "buys": (("due", "fx_nav"), """
SELECT d.*, n.date AS price_date, n.nav AS price FROM (SELECT * FROM due WHERE due <= least(coalesce(last_instalment, latest_date), latest_date)) d
ASOF JOIN fx_nav n ON d.scheme_code = n.scheme_code AND n.date >= d.due"""),
    "sip": (("buys",), f"""
SELECT plan_id, scheme_code, start_date AS "start", latest_date AS "end", {rnd('paid', 2)} AS invested, {rnd('units', 4)} AS units,
       {rnd('units * latest_nav', 2)} AS current_value, {rnd('units * latest_nav - paid', 2)} AS gain,
       {rnd('(units * latest_nav - paid) / paid * 100', 2)} AS absolute_return_pct
FROM (SELECT plan_id, scheme_code, start_date, latest_date, latest_nav, sum(amount) AS paid, sum(amount / price) AS units
      FROM buys GROUP BY ALL) g"""),
    "held": (("valid", "fx_nav"), """
SELECT v.*, n.date AS buy_date, n.nav AS buy_nav, v.amount / n.nav AS units
FROM valid v ASOF JOIN fx_nav n ON v.scheme_code = n.scheme_code AND n.date >= v.start_date"""),
    "lump": (("held",), f"""
SELECT plan_id, scheme_code, buy_date AS "start", latest_date AS "end", {rnd('amount', 2)} AS invested, {rnd('units', 4)} AS units,
       {rnd('units * latest_nav', 2)} AS current_value, {rnd('units * latest_nav - amount', 2)} AS gain,
       {rnd('(units * latest_nav - amount) / amount * 100', 2)} AS absolute_return_pct,
       {rnd("(pow(units * latest_nav / amount, 1 / greatest(date_diff('day', buy_date, latest_date) / 365e0, 1e-9)) - 1) * 100", 2)} AS cagr_pct
FROM held"""),
    "balances": (("fx_scenarios",), """
SELECT scenario_id, corpus, monthly_withdrawal AS w, annual_rate / 100 / 12 AS r, 0 AS month, corpus AS bal FROM fx_scenarios
UNION ALL
SELECT scenario_id, corpus, w, r, month + 1, bal * (1 + r) - w FROM balances WHERE bal > 0 AND month < 720"""),
    # cost and size per scheme, wide card
    "ter_now": (("fx_costs",), "SELECT scheme_code, arg_max(ter, as_of_date) AS ter, max(as_of_date) AS ter_as_of FROM fx_costs GROUP BY 1"),
    "aum_now": (("fx_aum",), "SELECT scheme_code, arg_max(aaum_cr, as_of_date) AS aaum_cr, max(as_of_date) AS aaum_as_of FROM fx_aum GROUP BY 1"),
    "card": (("master", "latest", "returns", "risk", "ranks", "ter_now", "aum_now", "proxies"), """
SELECT m.*, l.nav, l.date AS nav_date, a.aaum_cr, a.aaum_as_of, t.ter, t.ter_as_of, r1.ret AS ret_1y, r3.ret AS ret_3y, r5.ret AS ret_5y,
       k.sharpe AS sharpe_3y, q.percentile AS percentile_3y, p.proxy AS proxy_scheme_code, p.proxy_name, p.note AS proxy_note
FROM master m LEFT JOIN latest l USING (scheme_code) LEFT JOIN aum_now a USING (scheme_code) LEFT JOIN ter_now t USING (scheme_code)
LEFT JOIN returns r1 ON r1.scheme_code = m.scheme_code AND r1.period = '1Y'
LEFT JOIN returns r3 ON r3.scheme_code = m.scheme_code AND r3.period = '3Y'
LEFT JOIN returns r5 ON r5.scheme_code = m.scheme_code AND r5.period = '5Y'
LEFT JOIN risk k ON k.scheme_code = m.scheme_code AND k.period = '3Y'
LEFT JOIN ranks q ON q.scheme_code = m.scheme_code AND q.period = '3Y'
LEFT JOIN proxies p ON p.category = m.category"""),
}
_LIST = """scheme_code, name, amc, category, plan_type, option_type, nav, nav_date, ret_1y, ret_3y, ret_5y, sharpe_3y, percentile_3y,
  CASE WHEN percentile_3y IS NOT NULL THEN greatest(1, 100 - CAST(percentile_3y AS INT)) END AS top_share_3y, aaum_cr"""


def _q(names, select: str, extra: dict | None = None, recursive: bool = False) -> str:
    names = (names,) if isinstance(names, str) else names
    return with_ctes(names, select, {**CTES, **(extra or {})}, recursive)


def _tax(summary: str) -> str:
    return _q((summary, "fx_plans", "fx_master"), f"""
SELECT plan_id, tax_class, gain_type, {rnd('tax', 2)} AS tax,
       CASE WHEN gain_type = 'none' THEN 0e0 ELSE {rnd('tax / gain * 100', 2)} END AS effective_rate_pct
FROM (SELECT *, CASE gain_type WHEN 'none' THEN 0e0 WHEN 'slab' THEN gain * rate WHEN 'STCG' THEN gain * 2e-1
                ELSE greatest(0e0, gain - 125000e0) * 125e-3 END AS tax
  FROM (SELECT *, CASE WHEN gain <= 0 THEN 'none' WHEN tax_class = 'non_equity' THEN 'slab' WHEN held < 365 THEN 'STCG' ELSE 'LTCG' END AS gain_type
    FROM (SELECT plan_id, gain, held, rate, {_TAX_CLASS} AS tax_class
      FROM (SELECT s.plan_id, s.gain, date_diff('day', s."start", s."end") AS held, p.marginal_rate / 100 AS rate,
                   lower(coalesce(m.category, '') || ' ' || coalesce(m.name, '')) AS txt
            FROM {summary} s JOIN fx_plans p USING (plan_id) JOIN fx_master m ON m.scheme_code = s.scheme_code) a) b) c) d""")


def _cost_leak(amount: str, years: int | None) -> str:
    start = "greatest(d.first_date, r.first_date)"
    end = "least(d.date, r.date)"
    if years:
        start = f"greatest({start}, {end} - {years * 365})"
    extra = {
        "twins": (("fx_master",), """
SELECT fund_group_id, option_type, min(CASE WHEN plan_type = 'Direct' THEN scheme_code END) AS direct_code,
       min(CASE WHEN plan_type = 'Regular' THEN scheme_code END) AS regular_code
FROM fx_master WHERE plan_type IN ('Direct', 'Regular') AND fund_group_id IS NOT NULL GROUP BY 1, 2"""),
        "spans": (("twins", "latest"), f"""
SELECT * FROM (SELECT t.*, {start} AS s, {end} AS e FROM twins t JOIN latest d ON d.scheme_code = t.direct_code
  JOIN latest r ON r.scheme_code = t.regular_code) x WHERE date_diff('day', s, e) >= 365"""),
        "grown": (("spans", "fx_nav"), f"""
SELECT fund_group_id, option_type, e, buy_date, date_diff('day', buy_date, e) / 365e0 AS y,
       {amount} / d1 * d2 AS d, {amount} / r1 * r2 AS r
FROM (SELECT s.*,
   (SELECT arg_min(nav, date) FROM fx_nav n WHERE n.scheme_code = s.direct_code AND n.date >= s.s) AS d1,
   (SELECT min(date) FROM fx_nav n WHERE n.scheme_code = s.direct_code AND n.date >= s.s) AS buy_date,
   (SELECT arg_min(nav, date) FROM fx_nav n WHERE n.scheme_code = s.direct_code AND n.date >= s.e) AS d2,
   (SELECT arg_min(nav, date) FROM fx_nav n WHERE n.scheme_code = s.regular_code AND n.date >= s.s) AS r1,
   (SELECT arg_min(nav, date) FROM fx_nav n WHERE n.scheme_code = s.regular_code AND n.date >= s.e) AS r2
  FROM spans s) g"""),
    }
    return _q(("twins", "grown", "ter_now"), f"""
SELECT t.fund_group_id, t.option_type, t.direct_code, t.regular_code, dm.name AS direct_name, rm.name AS regular_name,
       {rnd('dt.ter', 2)} AS direct_ter, {rnd('rt.ter', 2)} AS regular_ter, g.d IS NOT NULL AS comparable,
       CASE WHEN t.direct_code IS NULL OR t.regular_code IS NULL THEN 'no matching Direct and Regular pair'
            WHEN g.d IS NULL THEN 'not enough shared history' END AS reason,
       g.buy_date AS "start", g.e AS "end", {rnd('g.y', 2)} AS years, {rnd('g.d', 2)} AS direct_value, {rnd('g.r', 2)} AS regular_value,
       {rnd(f'(pow(g.d / {amount}, 1 / g.y) - 1) * 100', 2)} AS direct_cagr, {rnd(f'(pow(g.r / {amount}, 1 / g.y) - 1) * 100', 2)} AS regular_cagr,
       {rnd('g.d - g.r', 2)} AS leak_rupees, {rnd(f'(g.d - g.r) / {amount} * 100', 2)} AS leak_pct_of_investment,
       {rnd(f'(pow(g.d / {amount}, 1 / g.y) - pow(g.r / {amount}, 1 / g.y)) * 100', 2)} AS drag_pct_per_year,
       CASE WHEN g.d IS NOT NULL THEN {rnd('rt.ter - dt.ter', 2)} END AS ter_gap
FROM twins t LEFT JOIN grown g ON g.fund_group_id = t.fund_group_id AND g.option_type = t.option_type
LEFT JOIN fx_master dm ON dm.scheme_code = t.direct_code LEFT JOIN fx_master rm ON rm.scheme_code = t.regular_code
LEFT JOIN ter_now dt ON dt.scheme_code = t.direct_code LEFT JOIN ter_now rt ON rt.scheme_code = t.regular_code""", extra)


_NEWTON = {
    "flows": (("buys",), """
SELECT plan_id, list(struct_pack(t := t, a := a) ORDER BY k) AS flows FROM (
  SELECT plan_id, k, date_diff('day', min(price_date) OVER (PARTITION BY plan_id), price_date) / 365e0 AS t, -amount AS a FROM buys
  UNION ALL
  SELECT plan_id, 100000, date_diff('day', min(price_date), any_value(latest_date)) / 365e0, sum(amount / price) * any_value(latest_nav)
  FROM buys GROUP BY plan_id) f GROUP BY plan_id"""),
    "newton": (("flows",), """
SELECT plan_id, flows, 1 AS step, 1e-1 AS rate, CAST(NULL AS DOUBLE) AS answer, FALSE AS done FROM flows
UNION ALL
SELECT plan_id, flows, step + 1, CASE WHEN rate <= -1 OR abs(fp) < 1e-12 THEN rate ELSE rate - f / fp END,
       CASE WHEN rate > -1 AND abs(fp) >= 1e-12 AND abs(f / fp) < 1e-8 THEN rate - f / fp END,
       rate <= -1 OR abs(fp) < 1e-12 OR abs(f / fp) < 1e-8
FROM (SELECT *, CASE WHEN rate > -1 THEN list_sum(list_transform(flows, lambda x: x.a / pow(1 + rate, x.t))) END AS f,
             CASE WHEN rate > -1 THEN list_sum(list_transform(flows, lambda x: -x.t * x.a / pow(1 + rate, x.t + 1))) END AS fp
      FROM newton WHERE NOT done AND step <= 100) n"""),
}

_LINES = {
    "filled": (("fx_lines",), f"""
SELECT *, last_value(CASE WHEN ctx AND sec THEN line END IGNORE NULLS) OVER w AS section,
       last_value(CASE WHEN ctx AND NOT sec THEN line END IGNORE NULLS) OVER w AS amc
FROM (SELECT *, string_split(line, ';') AS f, len(string_split(line, ';')) < 6 AS ctx,
             regexp_matches(line, '{K.SECTION_PATTERN}') AS sec FROM fx_lines) l
WINDOW w AS (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING)"""),
    "parsed": (("filled",), f"""
SELECT f[1] AS scheme_code, coalesce(CASE WHEN f[2] NOT IN ('', '-') THEN f[2] END, CASE WHEN f[3] NOT IN ('', '-') THEN f[3] END) AS isin,
       f[4] AS name, TRY_CAST(CASE WHEN len(f) >= 8 THEN f[7] ELSE f[5] END AS DOUBLE) AS nav,
       CAST(try_strptime(CASE WHEN len(f) >= 8 THEN f[8] ELSE f[6] END, '%d-%b-%Y') AS DATE) AS nav_date,
       trim(regexp_extract(section, '{K.SECTION_PATTERN}', 1)) AS scheme_type, trim(regexp_extract(section, '{K.SECTION_PATTERN}', 2)) AS category,
       amc, CASE WHEN len(f) >= 8 THEN f[5] ELSE f[4] END AS plan_src, CASE WHEN len(f) >= 8 THEN f[6] ELSE f[4] END AS option_src
FROM filled WHERE len(f) >= 6 AND regexp_matches(f[1], '^[0-9]+$')"""),
}

_TER = {
    "newest_ter": (("fx_ter",), """
SELECT mf_name, trim(Scheme_Name) AS scheme_name, arg_max(struct_pack(r := r, d := d), (dt, -ordinal)) AS t, max(dt) AS dt
FROM (SELECT *, coalesce(TRY_CAST(substr(TER_Date, 1, 10) AS DATE), DATE '0001-01-01') AS dt,
             CASE WHEN TRY_CAST(R_TER AS DOUBLE) > 0 AND TRY_CAST(R_TER AS DOUBLE) <= 3 THEN round(TRY_CAST(R_TER AS DOUBLE), 4) END AS r,
             CASE WHEN TRY_CAST(D_TER AS DOUBLE) > 0 AND TRY_CAST(D_TER AS DOUBLE) <= 3 THEN round(TRY_CAST(D_TER AS DOUBLE), 4) END AS d
      FROM fx_ter WHERE trim(Scheme_Name) <> '') x GROUP BY 1, 2"""),
    "ter_targets": (("newest_ter", "fx_master"), f"""
SELECT n.*, h.amc, {_sheet_identity('n.scheme_name')} AS target
FROM newest_ter n JOIN (SELECT DISTINCT amc, {_house_key('amc')} AS k FROM fx_master) h ON {_house_key('n.mf_name')} = h.k"""),
    **_resolution("ter_targets", "fx_master"),
    "ter_new": (("ter_targets", "resolved", "fx_master"), f"""
SELECT m.scheme_code, arg_max(CASE WHEN m.plan_type = 'Direct' THEN t.t.d ELSE t.t.r END, (t.dt, t.scheme_name)) AS ter
FROM ter_targets t JOIN resolved r USING (amc, target) JOIN fx_master m ON m.amc = r.amc AND {_identity('m.name')} = r.identity
WHERE CASE WHEN m.plan_type = 'Direct' THEN t.t.d ELSE t.t.r END IS NOT NULL GROUP BY 1"""),
}

_AUM = {"sized": (("fx_sizes",), f"""
SELECT code, coalesce(nullif(CASE WHEN TRY_CAST(headline AS DOUBLE) > 0 THEN {rnd('TRY_CAST(headline AS DOUBLE) / 100', 2)} END, 0),
                      nullif(CASE WHEN TRY_CAST(fof AS DOUBLE) > 0 THEN {rnd('TRY_CAST(fof AS DOUBLE) / 100', 2)} END, 0)) AS a, l_orderkey * 100 + l_linenumber AS ord FROM fx_sizes
UNION ALL SELECT code || 'F', nullif(CASE WHEN TRY_CAST(fof AS DOUBLE) > 0 THEN {rnd('TRY_CAST(fof AS DOUBLE) / 100', 2)} END, 0), l_orderkey * 100 + l_linenumber FROM fx_sizes""")}

# what the sheets must give back: the portfolios they were laid out from
_SHEETS = {
    "sheet_src": (("fx_holdings", "fx_master"), """
SELECT h.*, CAST(substr(h.scheme_code, 2) AS BIGINT) AS k, m.amc, CASE WHEN CAST(substr(h.scheme_code, 2) AS BIGINT) % 10 = 4 THEN 'Unlisted ' ELSE '' END || regexp_replace(m.name, ' - Regular Plan - Growth$', '') AS fund,
       lower(split_part(m.amc, ' ', 1)) || '-' || CAST(year(h.as_of_date) AS STRING) || '.xlsx' AS file,
       CASE WHEN CAST(substr(h.scheme_code, 2) AS BIGINT) % 10 = 9 THEN 30 ELSE 0 END AS junk
FROM fx_holdings h JOIN fx_master m USING (scheme_code)"""),
    "sheet_totals": (("sheet_src",), """
SELECT file, scheme_code, amc, k, fund, as_of_date, round(sum(pct_of_aum) + max(junk), 2) AS total FROM sheet_src GROUP BY ALL"""),
    "sheet_rows": (("sheet_src", "sheet_totals"), """
SELECT s.scheme_code, s.as_of_date, instrument_name, isin, CASE WHEN s.k % 3 = 2 THEN 'Debt / Money Market' ELSE sector END AS sector,
       pct_of_aum, market_value_cr FROM sheet_src s JOIN sheet_totals t ON t.scheme_code = s.scheme_code AND t.as_of_date = s.as_of_date
WHERE t.total <= 115 AND s.k % 10 <> 4"""),
}

ORACLES = {
    "scheme_returns": _q("returns", "SELECT * FROM returns"),
    "scheme_risk": _q("risk", "SELECT * FROM risk"),
    "quality_flags": _q("flags", "SELECT * FROM flags"),
    "price_jumps": _q(("fx_nav", "events"), """
SELECT n.scheme_code, count(e.date) AS jumps, min(e.date) AS first_jump
FROM (SELECT DISTINCT scheme_code FROM fx_nav) n LEFT JOIN events e USING (scheme_code) GROUP BY 1"""),
    "category_stats": _q("stats", "SELECT * FROM stats"),
    "rankings": _q("ranks", "SELECT * FROM ranks"),
    "rolling_stats": _q(("rolling", "fx_master", "proxies"), f"""
SELECT f.scheme_code, f."window", count(*) AS windows, {rnd('min(f.ret)', 2)} AS min, {rnd('quantile_cont(f.ret, 0.25)', 2)} AS p25,
       {rnd('quantile_cont(f.ret, 0.5)', 2)} AS median, {rnd('avg(f.ret)', 2)} AS avg, {rnd('quantile_cont(f.ret, 0.75)', 2)} AS p75, {rnd('max(f.ret)', 2)} AS max,
       {rnd('avg(CASE WHEN f.ret < 0 THEN 1e0 ELSE 0e0 END) * 100', 1)} AS pct_negative, {rnd('avg(CASE WHEN f.ret >= 8 THEN 1e0 ELSE 0e0 END) * 100', 1)} AS pct_above_8,
       {rnd('avg(CASE WHEN f.ret >= 12 THEN 1e0 ELSE 0e0 END) * 100', 1)} AS pct_above_12,
       CASE WHEN count(b.ret) >= 30 THEN {rnd('avg(CASE WHEN f.ret > b.ret THEN 1e0 WHEN b.ret IS NOT NULL THEN 0e0 END) * 100', 1)} END AS beat_benchmark_pct
FROM rolling f JOIN fx_master m ON m.scheme_code = f.scheme_code LEFT JOIN proxies p ON p.category = m.category AND p.proxy <> f.scheme_code
LEFT JOIN rolling b ON b.scheme_code = p.proxy AND b."window" = f."window" AND b.date = f.date
GROUP BY 1, 2 HAVING count(*) >= 30"""),
    "rolling_points": _q("rolling", f"""
SELECT scheme_code, "window", date, {rnd('ret', 2)} AS ret FROM (
  SELECT *, row_number() OVER (PARTITION BY scheme_code, "window" ORDER BY date) - 1 AS i,
         count(*) OVER (PARTITION BY scheme_code, "window") AS n FROM rolling) r
WHERE i % CAST(ceil(n / 400e0) AS BIGINT) = 0 OR i = n - 1"""),
    "overlap_pairs": _q(("pairs", "shared", "weights"), f"""
SELECT p.a, p.b, CASE WHEN x.d IS NOT NULL AND y.d IS NOT NULL THEN {rnd('coalesce(s.v, 0)', 2)} END AS overlap_pct,
       CASE WHEN x.d IS NOT NULL AND y.d IS NOT NULL THEN coalesce(s.n, 0) END AS common_count, coalesce(x.d <> y.d, FALSE) AS as_of_mismatch
FROM pairs p LEFT JOIN (SELECT scheme_code, max(as_of_date) AS d FROM weights GROUP BY 1) x ON x.scheme_code = p.a
LEFT JOIN (SELECT scheme_code, max(as_of_date) AS d FROM weights GROUP BY 1) y ON y.scheme_code = p.b
LEFT JOIN (SELECT a, b, sum(m) AS v, count(*) AS n FROM shared GROUP BY 1, 2) s ON s.a = p.a AND s.b = p.b"""),
    "set_overlaps": _q(("anchored", "shared", "weights"), f"""
SELECT p.set_id, p.a, p.b, CASE WHEN x.d IS NOT NULL AND y.d IS NOT NULL THEN {rnd('coalesce(s.v, 0)', 2)} END AS overlap_pct,
       CASE WHEN x.d IS NOT NULL AND y.d IS NOT NULL THEN coalesce(s.n, 0) END AS common_count, coalesce(x.d <> y.d, FALSE) AS as_of_mismatch
FROM anchored p LEFT JOIN (SELECT scheme_code, max(as_of_date) AS d FROM weights GROUP BY 1) x ON x.scheme_code = p.a
LEFT JOIN (SELECT scheme_code, max(as_of_date) AS d FROM weights GROUP BY 1) y ON y.scheme_code = p.b
LEFT JOIN (SELECT a, b, sum(m) AS v, count(*) AS n FROM shared GROUP BY 1, 2) s ON s.a = p.a AND s.b = p.b"""),
    "overlap_above": _q("classes", f"""
SELECT x.class AS a, y.class AS b, {rnd('sum(least(wa.pct, wb.pct))', 2)} AS overlap_pct, count(*) AS common_count, any_value(x.funds) AS a_funds, any_value(y.funds) AS b_funds
FROM classes x JOIN weights wa ON wa.scheme_code = x.class JOIN weights wb ON wb.isin = wa.isin JOIN classes y ON y.class = wb.scheme_code
WHERE x.scheme_code = x.class AND y.scheme_code = y.class AND x.class < y.class GROUP BY 1, 2 HAVING {rnd('sum(least(wa.pct, wb.pct))', 2)} >= 2e0"""),
    "portfolio_classes": _q("classes", "SELECT * FROM classes"),
    "overlap_top_common": _q("shared", f"""
SELECT a, b, rank, isin, name, {rnd('m', 2)} AS min_pct, {rnd('pa', 2)} AS a_pct, {rnd('pb', 2)} AS b_pct
FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY m DESC, isin) AS rank FROM shared) r WHERE rank <= 10"""),
    "combined_exposure": _q("exposure", "SELECT * FROM exposure"),
    "set_concentration": _q(("exposure", "fx_sets", "weights"), f"""
SELECT e.set_id, {rnd('sum(CASE WHEN e.rank <= 5 THEN e.pct END)', 2)} AS concentration_top5, {rnd('sum(e.pct)', 2)} AS concentration_top10,
       any_value(d.n) > 1 AS as_of_mismatch
FROM exposure e JOIN (SELECT set_id, count(DISTINCT as_of_date) AS n FROM fx_sets JOIN weights USING (scheme_code) GROUP BY 1) d USING (set_id)
GROUP BY 1"""),
    "rejected_sets": _q("fx_sets", """
SELECT set_id, count(*) AS funds, 'needs at least 2 schemes' AS reason FROM fx_sets GROUP BY 1 HAVING count(*) < 2"""),
    "covered_weight": _q("weights", f"""
SELECT scheme_code, as_of_date, count(*) AS holdings_count, {rnd('sum(pct)', 2)} AS covered_pct FROM weights GROUP BY 1, 2"""),
    "holdings_top": _q("disclosed", """
SELECT scheme_code, as_of_date, rank, isin, instrument_name, sector, pct_of_aum, market_value_cr
FROM (SELECT *, row_number() OVER (PARTITION BY scheme_code ORDER BY pct_of_aum DESC, isin) AS rank FROM disclosed) r WHERE rank <= 25"""),
    "sector_allocation": _q("disclosed", f"""
SELECT *, row_number() OVER (PARTITION BY scheme_code ORDER BY pct_of_aum DESC, sector) AS rank FROM (
  SELECT scheme_code, as_of_date, sector, {rnd('sum(pct_of_aum)', 4)} AS pct_of_aum FROM disclosed GROUP BY 1, 2, 3) s"""),
    "nightly_rebuild": _q(("returns", "risk", "master", "stats", "ranks"), """
SELECT 'scheme_returns' AS "table", count(*) AS "rows", sum(CAST(round(coalesce(ret, 0) * 100) AS BIGINT))::BIGINT AS value_sum FROM returns
UNION ALL SELECT 'scheme_risk', count(*), sum(CAST(round(coalesce(stdev, 0) * 100) + round(coalesce(sharpe, 0) * 100) + round(coalesce(beta, 0) * 100)
                                                   + round(coalesce(alpha, 0) * 100) + round(coalesce(max_drawdown, 0) * 100) AS BIGINT))::BIGINT FROM risk
UNION ALL SELECT 'scheme_master', count(*), sum(CASE data_quality WHEN 'stale' THEN 1 WHEN 'discontinuity' THEN 1000 ELSE 0 END)::BIGINT FROM master
UNION ALL SELECT 'category_stats', count(*), sum(CAST(round(avg_return * 100) + round(median_return * 100) AS BIGINT) + scheme_count)::BIGINT FROM stats
UNION ALL SELECT 'rankings', count(*), sum(rank_in_category + 7 * category_size + CAST(percentile AS BIGINT))::BIGINT FROM ranks"""),
    "cost_leak": _cost_leak("500000e0", None),
    "cost_leak_3y": _cost_leak("100000e0", 3),
    "backtest_validity": _q("validity", "SELECT * FROM validity"),
    "sip_summary": _q("sip", "SELECT * FROM sip"),
    "sip_series": _q("buys", f"""
SELECT plan_id, k AS instalment, price_date AS date, {rnd('sum(amount) OVER w', 2)} AS invested, {rnd('sum(amount / price) OVER w * price', 2)} AS value
FROM buys WINDOW w AS (PARTITION BY plan_id ORDER BY k ROWS UNBOUNDED PRECEDING)"""),
    "sip_xirr": _q(("flows", "newton"), f"""
SELECT plan_id, {rnd(rnd('max(answer)', 6) + ' * 100', 2)} AS xirr_pct FROM newton GROUP BY plan_id""", _NEWTON, recursive=True),
    "lumpsum_summary": _q("lump", "SELECT * FROM lump"),
    "lumpsum_series": _q(("held", "fx_nav"), f"""
SELECT plan_id, date, {rnd('amount', 2)} AS invested, {rnd('units * nav', 2)} AS value FROM (
  SELECT h.plan_id, h.amount, h.units, n.date, n.nav,
         row_number() OVER (PARTITION BY h.plan_id, date_trunc('month', n.date) ORDER BY n.date) AS i
  FROM held h JOIN fx_nav n ON n.scheme_code = h.scheme_code AND n.date >= h.buy_date) m WHERE i = 1"""),
    "sip_tax": _tax("sip"),
    "lumpsum_tax": _tax("lump"),
    "tax_classes": _q("fx_catalog", f"""
SELECT {_TAX_CLASS} AS tax_class, category, count(*) AS schemes FROM (SELECT category, lower(category || ' ' || name) AS txt FROM fx_catalog) c GROUP BY 1, 2"""),
    "plan_projections": _q("fx_scenarios", f"""
SELECT scenario_id, CAST(n AS INT) AS months, {rnd('lump', 2)} AS lump_value, {rnd('lump - amount', 2)} AS lump_gain, {rnd('amount * n', 2)} AS sip_invested,
       {rnd('amount * f', 2)} AS sip_value, {rnd('amount * f - amount * n', 2)} AS sip_gain, {rnd('corpus / f', 2)} AS goal_monthly, {rnd('corpus / f * n', 2)} AS goal_invested
FROM (SELECT *, CASE WHEN r = 0 THEN n ELSE (pow(1 + r, n) - 1) / r * (1 + r) END AS f FROM (
  SELECT *, amount * pow(1 + annual_rate / 100, years) AS lump, round_even(years * 12, 0) AS n, annual_rate / 100 / 12 AS r FROM fx_scenarios) a) b"""),
    "withdrawal_summary": _q("balances", """
SELECT scenario_id, CASE WHEN min(bal) <= 0 AND max(month) < 720 THEN max(month) END AS lasts_months,
       NOT (min(bal) <= 0 AND max(month) < 720) AS sustained FROM balances GROUP BY 1""", recursive=True),
    "withdrawal_schedule": _q("balances", f"""
SELECT scenario_id, CAST(month // 12 AS INT) AS year, {rnd('greatest(bal, 0)', 2)} AS balance FROM balances WHERE month > 0 AND month % 12 = 0""", recursive=True),
    "explorer_page": _q("card", f"""
SELECT {_LIST} FROM card WHERE is_active AND data_quality IS NULL ORDER BY ret_3y DESC NULLS LAST, name, scheme_code LIMIT 50"""),
    "explorer_late_page": _q("card", f"""
SELECT {_LIST} FROM card WHERE is_active AND data_quality IS NULL ORDER BY name NULLS LAST, scheme_code LIMIT 25 OFFSET 100"""),
    "explorer_search": _q("card", f"""
SELECT {_LIST} FROM card WHERE is_active AND data_quality IS NULL AND (name ILIKE '%b_rch%' OR amc ILIKE '%b_rch%')
  AND plan_type = 'Regular' AND option_type = 'Growth' ORDER BY nav NULLS LAST, name, scheme_code LIMIT 20 OFFSET 20"""),
    "explorer_total": _q("master", """
SELECT count(*) AS total FROM master WHERE is_active AND data_quality IS NULL AND (name ILIKE '%brand%' OR amc ILIKE '%brand%')
  AND category = 'Equity Scheme - Mid Cap Fund'"""),
    "scheme_detail": _q("card", """
SELECT *, CASE data_quality WHEN 'stale' THEN 'no recent price' WHEN 'discontinuity' THEN 'broken price series' END AS quality_label,
    CASE data_quality WHEN 'stale' THEN 'Last priced: ' || coalesce(CAST(nav_date AS STRING), 'unknown') || '. Not listed, not ranked.'
    WHEN 'discontinuity' THEN 'One day moves by more than 40%. Figures over spans with that day are null.' END AS quality_text,
  CASE WHEN percentile_3y >= 67 THEN 'top' WHEN percentile_3y >= 33 THEN 'middle' WHEN percentile_3y IS NOT NULL THEN 'bottom' END AS band_3y
FROM card"""),
    "period_rows": _q(("returns", "master", "proxies", "stats", "periods"), """
SELECT r.scheme_code, r.period, CAST(list_position(['1M','3M','6M','1Y','3Y','5Y','10Y'], r.period) AS BIGINT) AS position, r.ret AS fund_return,
       b.ret AS benchmark_return, s.avg_return AS category_avg_return
FROM returns r JOIN master m USING (scheme_code) LEFT JOIN proxies p ON p.category = m.category
LEFT JOIN returns b ON b.scheme_code = p.proxy AND b.period = r.period LEFT JOIN stats s ON s.category = m.category AND s.period = r.period"""),
    "chart_points": _q(("fx_nav", "latest"), f"""
SELECT scheme_code, "range", date, nav FROM (
  SELECT n.scheme_code, g.g AS "range", n.date, n.nav, row_number() OVER (PARTITION BY n.scheme_code, g.g ORDER BY n.date DESC) - 1 AS i,
         count(*) OVER (PARTITION BY n.scheme_code, g.g) AS c
  FROM fx_nav n JOIN latest l ON l.scheme_code = n.scheme_code
  JOIN (VALUES ('1Y', 365), ('3Y', 1095), ('5Y', 1825), ('max', 100000)) g(g, days) ON n.date >= l.date - g.days) s
WHERE i % greatest(1, c // 400 + CASE WHEN c % 400 > 0 THEN 1 ELSE 0 END) = 0"""),
    "compare_best": _q(("fx_compare", "returns", "risk", "periods"), """
SELECT set_id, metric, scheme_code, value, value IS NOT NULL AND row_number() OVER (PARTITION BY set_id, metric
         ORDER BY CASE WHEN metric = 'Volatility (3Y)' THEN -value ELSE value END DESC NULLS LAST, position) = 1 AS is_best
FROM (SELECT c.*, p.period || ' return' AS metric, r.ret AS value FROM fx_compare c CROSS JOIN periods p
      LEFT JOIN returns r ON r.scheme_code = c.scheme_code AND r.period = p.period
  UNION ALL SELECT c.*, 'Sharpe (3Y)', k.sharpe FROM fx_compare c LEFT JOIN risk k ON k.scheme_code = c.scheme_code AND k.period = '3Y'
  UNION ALL SELECT c.*, 'Volatility (3Y)', k.stdev FROM fx_compare c LEFT JOIN risk k ON k.scheme_code = c.scheme_code AND k.period = '3Y'
  UNION ALL SELECT c.*, 'Max drawdown (3Y)', k.max_drawdown FROM fx_compare c LEFT JOIN risk k ON k.scheme_code = c.scheme_code AND k.period = '3Y') m"""),
    "compare_table": _q(("fx_compare", "returns", "risk", "periods", "stats", "master", "proxies"), """
SELECT c.set_id, c.position, c.scheme_code, m.name, m.category, m.data_quality, p.period, r.ret AS fund_return,
       CASE WHEN r.ret IS NOT NULL THEN b.ret END AS benchmark_return, CASE WHEN r.ret IS NOT NULL THEN s.avg_return END AS category_avg_return,
       k.stdev, k.sharpe, k.beta, k.alpha, k.max_drawdown
FROM fx_compare c CROSS JOIN periods p LEFT JOIN master m ON m.scheme_code = c.scheme_code
LEFT JOIN returns r ON r.scheme_code = c.scheme_code AND r.period = p.period
LEFT JOIN proxies x ON x.category = m.category LEFT JOIN returns b ON b.scheme_code = x.proxy AND b.period = p.period
LEFT JOIN stats s ON s.category = m.category AND s.period = p.period
LEFT JOIN risk k ON k.scheme_code = c.scheme_code AND k.period = p.period"""),
    "facets": _q("master", """
SELECT 'category' AS facet, category AS value, count(*) AS count FROM master WHERE is_active AND data_quality IS NULL AND category IS NOT NULL GROUP BY 2
UNION ALL SELECT 'amc', amc, count(*) FROM master WHERE is_active AND data_quality IS NULL AND amc IS NOT NULL GROUP BY 2"""),
    "freshness": _q(("fx_nav", "fx_holdings", "fx_costs"), f"""
SELECT source, latest, CAST(date_diff('day', latest, {AS_OF_SQL}) AS INT) AS age_days,
       coalesce(date_diff('day', latest, {AS_OF_SQL}) > stale_after_days, TRUE) AS stale, stale_after_days FROM (
  SELECT 'nav' AS source, max(date) AS latest, 4 AS stale_after_days FROM fx_nav
  UNION ALL SELECT 'holdings', max(as_of_date), 45 FROM fx_holdings UNION ALL SELECT 'costs', max(as_of_date), 100 FROM fx_costs) s"""),
    "benchmark_map": _q(("fx_catalog", "proxies"), """
SELECT c.category, p.proxy AS proxy_scheme_code, p.proxy_name, count(*) AS schemes FROM fx_catalog c LEFT JOIN proxies p USING (category) GROUP BY 1, 2, 3"""),
    "name_functions": _q("fx_catalog", f"""
SELECT scheme_code, {_plan('name')} AS plan_type, {_option('name')} AS option_type, {_group_id('amc', 'name')} AS fund_group_id,
       CASE WHEN category LIKE '% - %' THEN trim(substr(category, strpos(category, ' - ') + 3)) END AS sub_category,
       array_to_string({_words('name')}, ' ') AS tokens, {_identity('name')} AS identity, {_sheet_identity('name')} AS sheet_identity,
       {_house_key('amc')} AS house_key FROM fx_catalog"""),
    "name_resolution": _q("resolved", "SELECT * FROM resolved", {
        "named_targets": (("fx_targets",), f"SELECT amc, {_sheet_identity('title')} AS target FROM fx_targets"),
        **_resolution("named_targets", "fx_catalog")}),
    "daily_file": _q("parsed", f"""
SELECT scheme_code, isin, name, nav, nav_date, scheme_type, category,
       CASE WHEN category LIKE '% - %' THEN trim(substr(category, strpos(category, ' - ') + 3)) END AS sub_category, amc,
       {_plan('plan_src')} AS plan_type, {_option('option_src')} AS option_type, {_group_id('amc', 'name')} AS fund_group_id FROM parsed""", _LINES),
    "landed_daily_file": _q("parsed", "SELECT scheme_code, nav, nav_date, category, amc FROM parsed", _LINES),
    "daily_file_ingest": _q("parsed", """
SELECT scheme_code, nav_date AS date, max(nav) AS nav FROM parsed WHERE nav IS NOT NULL AND nav_date IS NOT NULL GROUP BY 1, 2""", _LINES),
    "unlinked_plans": _q("fx_master", """
SELECT scheme_code, plan_type, option_type, 'not linked to a fund group' AS reason FROM fx_master
WHERE plan_type IN ('Direct', 'Regular') AND NOT EXISTS (
  SELECT 1 FROM fx_master d JOIN fx_master r ON d.fund_group_id = r.fund_group_id AND d.option_type = r.option_type
  WHERE d.plan_type = 'Direct' AND r.plan_type = 'Regular' AND d.fund_group_id = fx_master.fund_group_id)"""),
    "history_json": _q("fx_nav", "SELECT scheme_code, date, nav FROM fx_nav WHERE day(date) NOT IN (13, 17, 29) AND nav > 0"),
    "price_upsert": _q(("fx_nav", "latest"), f"""
SELECT scheme_code, date, CASE WHEN date >= DATE '2001-08-01' THEN round(nav * 2, 4) ELSE nav END AS nav FROM fx_nav
UNION ALL SELECT scheme_code, {AS_OF_SQL}, nav FROM latest"""),
    "price_backfill": _q("fx_nav", "SELECT scheme_code, date, CASE WHEN date >= DATE '1998-01-01' THEN nav ELSE round(nav * 3, 4) END AS nav FROM fx_nav"),
    "stream_ingest": """
SELECT 'U' || CAST(user_id AS STRING) AS scheme_code, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS nav FROM events GROUP BY 1, 2""",
    "master_sync": _q(("fx_master_old", "fx_master_new"), f"""
SELECT scheme_code, CASE WHEN seen THEN n_name ELSE name END AS name, CASE WHEN seen THEN n_amc ELSE amc END AS amc,
       CASE WHEN seen THEN n_type END AS scheme_type, CASE WHEN seen THEN n_category ELSE category END AS category, CAST(NULL AS STRING) AS sub_category,
       CASE WHEN seen THEN 'Regular' ELSE plan_type END AS plan_type, CASE WHEN seen THEN 'IDCW' ELSE option_type END AS option_type,
       n_isin AS isin, n_group AS fund_group_id, seen OR last_seen >= {AS_OF_SQL} - 30 AS is_active,
       coalesce(first_seen, {AS_OF_SQL}) AS first_seen, CASE WHEN seen THEN {AS_OF_SQL} ELSE last_seen END AS last_seen
FROM (SELECT coalesce(o.scheme_code, n.scheme_code) AS scheme_code, n.scheme_code IS NOT NULL AS seen, o.name, o.amc, o.category, o.plan_type, o.option_type,
             o.first_seen, o.last_seen, n.name AS n_name, n.amc AS n_amc, n.scheme_type AS n_type, n.category AS n_category, n.isin AS n_isin, n.fund_group_id AS n_group
      FROM fx_master_old o FULL OUTER JOIN (SELECT DISTINCT scheme_code, name, amc, scheme_type, category, isin, fund_group_id FROM fx_master_new) n
        ON n.scheme_code = o.scheme_code) j"""),
    "pending_backfill": _q("fx_master", "SELECT scheme_code, plan_type FROM fx_master WHERE backfill_status IS NULL"),
    "backfill_marks": _q(("fx_master", "fx_nav"), f"""
SELECT scheme_code, CASE WHEN old = 'done' THEN 'done' WHEN scheme_code IN (SELECT scheme_code FROM fx_nav) THEN 'done' ELSE 'no_data' END AS backfill_status,
       CASE WHEN old IS NULL THEN {AS_OF_SQL} END AS backfill_date
FROM (SELECT scheme_code, CASE WHEN plan_type = 'Direct' THEN backfill_status END AS old FROM fx_master) m"""),
    "ter_load": _q(("fx_costs", "ter_new"), """
SELECT coalesce(c.scheme_code, n.scheme_code) AS scheme_code, coalesce(c.as_of_date, DATE '2001-11-01') AS as_of_date, coalesce(n.ter, c.ter) AS ter
FROM fx_costs c FULL OUTER JOIN ter_new n ON n.scheme_code = c.scheme_code AND c.as_of_date = DATE '2001-11-01'""", _TER),
    "ter_report": _q(("ter_targets", "resolved", "fx_ter", "fx_master"), f"""
SELECT t.amc, count(*) AS unmatched FROM ter_targets t JOIN resolved r USING (amc, target) WHERE r.identity IS NULL GROUP BY 1
UNION ALL SELECT DISTINCT mf_name, CAST(NULL AS BIGINT) FROM fx_ter
WHERE {_house_key('mf_name')} NOT IN (SELECT {_house_key('amc')} FROM fx_master)""", _TER),
    "aum_load": _q(("sized", "fx_catalog"), """
SELECT code AS scheme_code, DATE '2001-12-31' AS as_of_date, arg_max(a, ord) AS aaum_cr FROM sized WHERE a IS NOT NULL
  AND code IN (SELECT scheme_code FROM fx_catalog) GROUP BY 1""", _AUM),
    "aum_upsert": _q(("sized", "fx_catalog"), """
SELECT coalesce(s.scheme_code, n.code) AS scheme_code, coalesce(s.as_of_date, DATE '2001-12-31') AS as_of_date, coalesce(n.a, s.aaum_cr) AS aaum_cr, s.source
FROM (SELECT scheme_code, CASE WHEN p_size <= 25 THEN DATE '2001-12-31' ELSE DATE '2001-09-30' END AS as_of_date,
             CAST(p_retailprice AS DOUBLE) AS aaum_cr, p_type AS source FROM fx_catalog) s
FULL OUTER JOIN (SELECT code, arg_max(a, ord) AS a FROM sized WHERE a IS NOT NULL AND code IN (SELECT scheme_code FROM fx_catalog) GROUP BY 1) n
  ON n.code = s.scheme_code AND s.as_of_date = DATE '2001-12-31'""", _AUM),
    "benchmark_seed": _q(("fx_catalog", "proxies"), """
SELECT category, proxy AS proxy_scheme_code, proxy_name, note FROM proxies
UNION ALL SELECT DISTINCT category, '0', 'old', 'old' FROM fx_catalog WHERE category NOT IN (SELECT category FROM proxies)"""),
    "aum_unknown": _q(("sized", "fx_catalog"), """
SELECT DISTINCT code AS scheme_code FROM sized WHERE a IS NOT NULL AND code NOT IN (SELECT scheme_code FROM fx_catalog)""", _AUM),
    "period_ends": _q("fx_nav", """
SELECT monthname(q) || ' - ' || monthname(q + INTERVAL 2 MONTH) || ' ' || CAST(year(q) AS STRING) AS label, count(*) AS prices,
       last_day(CAST(q + INTERVAL 2 MONTH AS DATE)) AS period_end
FROM (SELECT date_trunc('quarter', date) AS q FROM fx_nav) p GROUP BY q"""),
    "newest_links": _q("fx_links", """
SELECT amc, d AS link_date, max(url) AS url FROM (
  SELECT *, max(d) OVER (PARTITION BY amc) AS newest FROM (
    SELECT amc, url, CAST(coalesce(try_strptime(regexp_extract(url, '(\\d+)th-([A-Z][a-z]{2})[a-z]*-(\\d{4})', 1) || ' ' ||
                                           regexp_extract(url, '(\\d+)th-([A-Z][a-z]{2})[a-z]*-(\\d{4})', 2) || ' ' ||
                                           regexp_extract(url, '(\\d+)th-([A-Z][a-z]{2})[a-z]*-(\\d{4})', 3), '%d %b %Y'),
                              try_strptime(regexp_extract(url, '-([A-Z][a-z]{2})[a-z]*-(\\d+),-(\\d{4})', 2) || ' ' ||
                                           regexp_extract(url, '-([A-Z][a-z]{2})[a-z]*-(\\d+),-(\\d{4})', 1) || ' ' ||
                                           regexp_extract(url, '-([A-Z][a-z]{2})[a-z]*-(\\d+),-(\\d{4})', 3), '%d %b %Y')) AS DATE) AS d FROM fx_links) p) q
WHERE d = newest GROUP BY 1, 2"""),
    "sheet_holdings": _q("sheet_rows", "SELECT * FROM sheet_rows", _SHEETS),
    "sheet_sectors": _q("sheet_rows", f"SELECT scheme_code, as_of_date, sector, {rnd('sum(pct_of_aum)', 4)} AS pct_of_aum FROM sheet_rows GROUP BY 1, 2, 3", _SHEETS),
    "sheet_suspects": _q("sheet_totals", """
SELECT file, scheme_code AS sheet, fund || CASE WHEN k % 3 = 1 THEN ' (An Open Ended Scheme)' ELSE '' END AS scheme_name, as_of_date,
       total AS total_pct FROM sheet_totals WHERE total > 115""", _SHEETS),
    "sheet_report": _q("sheet_totals", """
SELECT amc, count(*) AS sheets, count(CASE WHEN total > 115 THEN 1 END) AS suspect, count(CASE WHEN total <= 115 AND k % 10 <> 4 THEN 1 END) AS matched,
       count(CASE WHEN total <= 115 AND k % 10 = 4 THEN 1 END) AS unmatched
FROM sheet_totals GROUP BY 1""", _SHEETS),
    "sheet_quarantine": _q("sheet_totals", """
SELECT file, scheme_code AS sheet, CASE WHEN total > 115 THEN 'suspect weights' ELSE 'no such fund' END AS reason FROM sheet_totals WHERE total > 115 OR k % 10 = 4
UNION ALL SELECT file, scheme_code || '-note', CASE k % 10 WHEN 2 THEN 'no header row' WHEN 3 THEN 'header lacks a column' ELSE 'no valid line' END
FROM sheet_totals WHERE k % 10 IN (2, 3, 5)""", _SHEETS),
    "holdings_replace": _q("fx_holdings", f"""
SELECT scheme_code, as_of_date, instrument_name, isin, sector, {rnd('pct_of_aum / 2', 4)} AS pct_of_aum, market_value_cr
FROM fx_holdings WHERE year(as_of_date) = 2001 AND sector <> 'ECONOMY'
UNION ALL SELECT h.* FROM fx_holdings h WHERE NOT EXISTS (SELECT 1 FROM fx_holdings n WHERE year(n.as_of_date) = 2001 AND n.sector <> 'ECONOMY'
  AND n.scheme_code = h.scheme_code AND n.as_of_date = h.as_of_date)"""),
}
ORACLES["price_store"] = ORACLES["price_upsert"]
ORACLES["pinned_prices"] = _q("fx_nav", "SELECT scheme_code, date, nav FROM fx_nav")
ORACLES["kept_tables"] = f"""SELECT scheme_code, period, ret, r.as_of_date AS latest, stdev, sharpe, beta, alpha, max_drawdown, k.as_of_date
FROM ({ORACLES["scheme_returns"]}) r FULL JOIN ({ORACLES["scheme_risk"]}) k USING (scheme_code, period)"""
