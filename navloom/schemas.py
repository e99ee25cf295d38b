"""Table schemas. Money and prices are DOUBLE, all times are day-grain dates."""

SCHEME_MASTER = ("scheme_code STRING, name STRING, amc STRING, scheme_type STRING, category STRING, "
                 "sub_category STRING, plan_type STRING, option_type STRING, isin STRING, launch_date DATE, "
                 "benchmark_name STRING, risk_level STRING, is_active BOOLEAN, data_quality STRING, "
                 "fund_group_id STRING, backfill_status STRING, backfill_date DATE, first_seen DATE, last_seen DATE")
NAV_HISTORY = "scheme_code STRING, date DATE, nav DOUBLE"
SCHEME_RETURNS = "scheme_code STRING, period STRING, ret DOUBLE, as_of_date DATE"
SCHEME_RISK = ("scheme_code STRING, period STRING, stdev DOUBLE, sharpe DOUBLE, beta DOUBLE, alpha DOUBLE, "
               "max_drawdown DOUBLE, as_of_date DATE")
CATEGORY_STATS = ("category STRING, period STRING, avg_return DOUBLE, median_return DOUBLE, "
                  "scheme_count BIGINT, as_of_date DATE")
RANKINGS = ("scheme_code STRING, period STRING, category STRING, rank_in_category BIGINT, "
            "category_size BIGINT, percentile DOUBLE, as_of_date DATE")
BENCHMARK_PROXY = "category STRING, proxy_scheme_code STRING, proxy_name STRING, note STRING"
SCHEME_COSTS = "scheme_code STRING, as_of_date DATE, ter DOUBLE, exit_load STRING, min_investment DOUBLE"
SCHEME_AUM = "scheme_code STRING, as_of_date DATE, aaum_cr DOUBLE"
HOLDINGS = ("scheme_code STRING, as_of_date DATE, instrument_name STRING, isin STRING, sector STRING, "
            "pct_of_aum DOUBLE, market_value_cr DOUBLE")
SECTOR_ALLOCATION = "scheme_code STRING, as_of_date DATE, sector STRING, pct_of_aum DOUBLE"

# landed feeds
CELLS = "file STRING, sheet STRING, row_idx INT, col_idx INT, text STRING, num DOUBLE, dt DATE"
NAV_JSON = "scheme_code STRING, data ARRAY<STRUCT<date: STRING, nav: STRING>>"
TER_RECORDS = "Scheme_Name STRING, R_TER STRING, D_TER STRING, TER_Date STRING"
AUM_SIZE = ("STRUCT<ExcludingFundOfFundsDomesticButIncludingFundOfFundsOverseas: STRING, "
            "FundOfFundsDomestic: STRING>")
AUM_GROUPS = ("ordinal BIGINT, Mfname STRING, SchemeCat_Desc STRING, schemes ARRAY<STRUCT<SchemeNAVName: STRING, "
              f"AMFI_Code: STRING, AverageAumForTheMonth: {AUM_SIZE}>>")
