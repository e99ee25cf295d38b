"""Thresholds, period lengths, word lists and lookup tables.

These must equal the values that define the metrics, so they are stated here
once, as plain data.
"""

# --- fixed values: periods and windows (days) --------------------------------
PERIOD_DAYS = {"1M": 30, "3M": 91, "6M": 182, "1Y": 365, "3Y": 1095, "5Y": 1825, "10Y": 3650}
RISK_DAYS = {"1Y": 365, "3Y": 1095}
ROLLING_DAYS = {"1M": 30, "3M": 91, "6M": 182, "1Y": 365, "2Y": 730, "3Y": 1095,
                "5Y": 1825, "7Y": 2555, "10Y": 3650}
CHART_RANGE_DAYS = {"1Y": 365, "3Y": 1095, "5Y": 1825, "max": None}

# --- fixed values: metric thresholds -----------------------------------------
ANCHOR_TOLERANCE_DAYS = 14      # a past price may be this much older than its target
WINDOW_END_TOLERANCE_DAYS = 7   # a rolling window may close this much late
JUMP_LIMIT = 0.40               # a larger one-step change has no economic meaning
STALE_AFTER_DAYS = 45
JUMP_LOOKBACK_DAYS = 365
RISK_FREE_PCT = 6.5
TRADING_DAYS = 252
MIN_RISK_POINTS = 150
RISK_HISTORY_SLACK_DAYS = 60
MIN_PROXY_COVERAGE = 0.9
MIN_ROLLING_WINDOWS = 30
MAX_CHART_POINTS = 400
MIN_SHARED_DAYS = 365
MIN_NAME_TOKENS = 2
MAX_PORTFOLIO_WEIGHT = 115.0
INACTIVE_AFTER_DAYS = 30
MAX_PLAUSIBLE_TER = 3.0
FRESHNESS_DAYS = {"nav": 4, "holdings": 45, "costs": 100}

# --- fixed values: portfolio-sheet layout -------------------------------------
SHEET_LABELS = {
    "name": ["name of the instrument", "name of instrument"],
    "isin": ["isin"],
    "industry": ["industry", "rating"],
    "market_value": ["market", "fair value"],
    "pct": ["% to net", "% of net", "% to nav", "% to aum", "% of aum", "% to total"],
}

# --- fixed values: patterns ----------------------------------------------------
ISIN_PATTERN = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
RATING_PATTERN = r"(?i)CRISIL|ICRA|CARE|FITCH|IND\b|A1\+|AAA|AA\+|SOV|UNRATED"
SECTION_PATTERN = r"(?i)^(.*?Schemes?)\s*\(\s*(.*?)\s*\)\s*$"
AS_ON_PATTERN = (r"(?i)as\s+(?:on|at)\s+([A-Za-z]+\s+\d{1,2},?\s*\d{4}"
                 r"|\d{1,2}[-\s][A-Za-z]+[-\s]\d{4})")
HOUSE_LINE_PATTERN = (r"(?i)^(?:name\s+of\s+(?:the\s+)?(?:mutual\s+fund|amc)\s*[:\-]\s*)?"
                      r"[\w .&',\-]{0,45}\bmutual fund\.?$")
PLAN_PATTERNS = {"Direct": r"(?i)\bdirect\b", "Regular": r"(?i)\bregular\b"}
OPTION_PATTERNS = {"IDCW": r"(?i)\bidcw\b|\bdcw\b|\bdividend\b|income distribution", "Growth": r"(?i)\bgrowth\b"}
TITLE_HEAD_PATTERN = r"(?i)^portfolio\s+of\s+"
TITLE_TAIL_PATTERN = r"(?i)\s+as\s+(?:on|at|of)\b.*$"
MONTH_PATTERN = ("jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|"
                 "aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?")
LINK_DAY_FIRST_PATTERN = rf".*?(\d{{1,2}})(?:st|nd|rd|th)?[-_ ]({MONTH_PATTERN})[-_ ](\d{{2,4}}).*"
LINK_MONTH_FIRST_PATTERN = rf".*?({MONTH_PATTERN})[-_ ](\d{{1,2}})(?:st|nd|rd|th)?,?[-_ ](\d{{2,4}}).*"

# --- fixed values: name-normalising word lists ---------------------------------
GROUP_ID_WORDS = ("direct|regular|growth|idcw|dividend|div|bonus|payout|reinvestment|re-?investment|"
                  "income distribution cum capital withdrawal|daily|weekly|fortnightly|monthly|quarterly|"
                  "half yearly|halfyearly|annual|periodic|option|plan|of|cum|capital|withdrawal|income|distribution")
MASTER_STRIP_PATTERN = (r"(?i)\(.*?\)|\b(direct|regular|dir|reg)\b|\bplan\b|\bgrowth\b|\bidcw\b|\bdividend\b|"
                        r"\bpayout\b|\breinvestment\b|\boption\b|\bfund\b|"
                        r"\b(daily|weekly|fortnightly|monthly|quarterly|half\s*yearly|yearly|annual|normal)\b")
SHEET_STRIP_PATTERN = r"(?i)\(.*?\)|\bfund\b|\bscheme\b"
FUND_SPLIT_PATTERN = r"(?is)^(.*?)\bfunds?\b(.*)$"
JOIN_WORDS = ["and", "the"]
PLAN_WORDS = ["direct", "regular", "dir", "reg", "plan", "growth", "idcw", "dividend", "payout",
              "reinvestment", "option", "options", "bonus", "income", "distribution", "cum", "capital",
              "withdrawal", "of", "daily", "weekly", "fortnightly", "monthly", "quarterly", "half",
              "yearly", "annual", "normal"]

# --- fixed values: tax rules ----------------------------------------------------
STCG_RATE = 0.20
LTCG_RATE = 0.125
LTCG_EXEMPTION = 125000.0
LTCG_MIN_DAYS = 365
DEFAULT_MARGINAL_RATE = 0.30
NON_EQUITY_WORDS = ["debt", "gilt", "liquid", "overnight", "money market", "income", "conservative hybrid",
                    "gold", "silver", "fof overseas", "overseas", "banking and psu", "corporate bond",
                    "credit risk", "floater", "duration"]
EQUITY_INDEX_WORDS = ["nifty", "sensex", "bse", "midcap", "smallcap", "next 50"]

# --- fixed values: projections and XIRR ------------------------------------------
MAX_WITHDRAWAL_YEARS = 60
XIRR_GUESS = 0.1
XIRR_STEPS = 100
XIRR_TOLERANCE = 1e-8
XIRR_MIN_SLOPE = 1e-12

# --- fixed values: category -> benchmark fund -------------------------------------
_NIFTY50 = ("120716", "UTI Nifty 50 Index Fund - Direct")
_NIFTY500 = ("147625", "Motilal Oswal Nifty 500 Index Fund - Direct")
_MIDCAP150 = ("147622", "Motilal Oswal Nifty Midcap 150 Index Fund - Direct")
_SMALLCAP250 = ("147623", "Motilal Oswal Nifty Smallcap 250 Index Fund - Direct")
_BROAD = "Broad-market reference; free sector/style indices are not available"
BENCHMARK_PROXIES = [
    ("Equity Scheme - Large Cap Fund", *_NIFTY50, None),
    ("Equity Schemes - Large Cap Fund", *_NIFTY50, None),
    ("Equity Scheme - Mid Cap Fund", *_MIDCAP150, None),
    ("Equity Scheme - Small Cap Fund", *_SMALLCAP250, None),
    ("Equity Schemes - Small Cap Fund", *_SMALLCAP250, None),
    ("Equity Scheme - Large & Mid Cap Fund", *_NIFTY500, _BROAD),
    ("Equity Scheme - Flexi Cap Fund", *_NIFTY500, None),
    ("Equity Schemes - Flexi Cap Fund", *_NIFTY500, None),
    ("Equity Scheme - Multi Cap Fund", *_NIFTY500, None),
    ("Equity Schemes - Multi Cap Fund", *_NIFTY500, None),
    ("Equity Scheme - ELSS", *_NIFTY500, None),
    ("Equity Schemes - ELSS- Tax Saver Fund", *_NIFTY500, None),
    ("Equity Scheme - Focused Fund", *_NIFTY500, None),
    ("Equity Schemes - Focused Fund", *_NIFTY500, None),
    ("Equity Scheme - Value Fund", *_NIFTY500, None),
    ("Equity Schemes - Value Fund", *_NIFTY500, None),
    ("Equity Scheme - Contra Fund", *_NIFTY500, None),
    ("Equity Scheme - Dividend Yield Fund", *_NIFTY500, None),
    ("Equity Scheme - Sectoral/ Thematic", *_NIFTY500, _BROAD),
    ("Equity Schemes - Sectoral Fund", *_NIFTY500, _BROAD),
    ("Equity Schemes - Thematic Fund", *_NIFTY500, _BROAD),
]
