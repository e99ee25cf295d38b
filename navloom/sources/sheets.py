"""Portfolio sheets to holdings.

The input is a long table of cells (schemas.CELLS); empty cells are absent. A
sheet of any size is handled with aggregates per sheet or per row; only the rows
above the header are gathered, each an array as wide as the sheet at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions import feeds, names
from navloom.functions.rounding import rnd
from navloom.session import settle, settle_by

SHEET = ["file", "sheet"]
_LETTERS = "[A-Za-z]{3}"


def _contains_any(text: Column, labels: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(label) for label in labels])


def header_rows(cells: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """(file, sheet, header): the first row that names instrument and ISIN, wherever it
    stands, or within ``scan_rows`` if given. Rows are told apart by flags per cell, so
    that nothing is gathered for the rows of a long sheet."""
    label = F.lower("text")
    rows = cells.filter(F.col("text") != "")
    if scan_rows is not None:
        rows = rows.filter(F.col("row_idx") <= scan_rows)
    found = rows.filter(_contains_any(label, K.SHEET_LABELS["name"]) | label.contains("isin")).groupBy(*SHEET, "row_idx").agg(
        F.max(_contains_any(label, K.SHEET_LABELS["name"])).alias("named"), F.max(label.contains("isin")).alias("coded"))
    return found.filter("named AND coded").groupBy(*SHEET).agg(F.min("row_idx").alias("header"))


def title_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, sheet, header, row_idx, cells) of the rows up to the header; a cell with a date
    counts even if it has no text."""
    top = cells.filter((F.col("text") != "") | F.col("dt").isNotNull()).join(headers, SHEET).filter(F.col("row_idx") <= F.col("header"))
    text = F.coalesce(names.strip(F.col("text")), F.lit(""))
    return top.groupBy(*SHEET, "header", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", text.alias("text"), "dt"))).alias("cells"))


def column_map(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, sheet, header, c_<field>): the first column whose label fits."""
    label = F.lower(F.replace("text", F.lit("\n"), F.lit(" ")))
    first = [F.min(F.when(_contains_any(label, labels), F.col("col_idx"))).alias(f"c_{field}")
             for field, labels in K.SHEET_LABELS.items()]
    return (cells.join(headers, SHEET).filter(F.col("row_idx") == F.col("header"))
               .groupBy(*SHEET, "header").agg(*first)
               .filter(F.col("c_name").isNotNull() & F.col("c_isin").isNotNull() & F.col("c_pct").isNotNull()))


def _scheme_label(cells: Column) -> Column:
    """Value of the first usable 'Scheme Name' label of a row, else null."""
    labels = F.filter(cells, lambda c: F.lower(c["text"]).contains("scheme name"))

    def value(label: Column) -> Column:
        after = names.strip(F.regexp_extract(label["text"], "(?s)^[^:]*:(.*)$", 1))
        later = F.filter(cells, lambda c: (c["col_idx"] > label["col_idx"]) & (F.length(c["text"]) > 3))
        return F.when(F.length(after) > 3, after).otherwise(F.get(later, F.lit(0))["text"])

    return F.get(F.filter(F.transform(labels, value), lambda v: v.isNotNull()), F.lit(0))


def _title_text(cells: Column) -> Column:
    """First cell of several words that is not the house's name."""
    def fits(c: Column) -> Column:
        t = c["text"]
        return (F.length(t) > 5) & t.contains(" ") & t.rlike(_LETTERS) & ~t.rlike(K.HOUSE_LINE_PATTERN)

    title = F.get(F.filter(cells, fits), F.lit(0))["text"]
    return names.strip(F.regexp_replace(F.regexp_replace(title, K.TITLE_HEAD_PATTERN, ""), K.TITLE_TAIL_PATTERN, ""))


def sheet_titles(above: DataFrame, as_of: str, date_rows: int | None = None) -> DataFrame:
    """(file, sheet, scheme_name, as_of_date) read above the header. A date cell
    not later than ``as_of`` comes before an 'as on' text; ``date_rows`` cuts the date
    scan short of the header."""
    in_title = F.col("row_idx") < F.col("header")
    scanned = in_title if date_rows is None else in_title & (F.col("row_idx") <= date_rows)
    day = F.get(F.filter("cells", lambda c: c["dt"] <= F.lit(as_of).cast("date")), F.lit(0))["dt"]
    worded = F.get(F.filter(F.transform("cells", lambda c: feeds.as_on_date(c["text"])), lambda d: d.isNotNull()), F.lit(0))
    found = above.select(
        *SHEET, "row_idx", F.when(scanned, day).alias("day"), F.when(scanned, worded).alias("worded"),
        F.when(in_title, _scheme_label(F.col("cells"))).alias("label"), F.when(in_title, _title_text(F.col("cells"))).alias("title"))

    def first(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("row_idx")))

    return found.groupBy(*SHEET).agg(F.coalesce(first("label"), first("title")).alias("scheme_name"),
                                     F.coalesce(first("day"), first("worded")).alias("as_of_date"))


def sheet_lines(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows below the header that carry a valid ISIN and a name, unscaled. A name
    missing from its column is taken from the cell left, then right, of the ISIN."""
    col = F.col("col_idx")
    wanted = col.isin(F.col("c_name"), F.col("c_isin"), F.col("c_pct"), F.col("c_isin") - 1, F.col("c_isin") + 1, F.col("c_industry"), F.col("c_market_value"))
    # sheets are few beside cells: hashing them leaves the cells unsorted until their rows are put together
    text = F.col("text")
    # a projection of its own strips a text once, however often it is looked at below
    body = (cells.join(columns.hint("shuffle_hash"), SHEET).filter((F.col("row_idx") > F.col("header")) & wanted)
            .withColumn("text", F.nullif(names.strip(text), F.lit(""))))
    usable = F.coalesce(col != F.col("c_industry"), F.lit(True)) & text.rlike(_LETTERS) & ~names.is_isin(text)
    parts = {"isin": col == F.col("c_isin"), "own_name": col == F.col("c_name"), "left_name": col == F.col("c_isin") - 1,
             "right_name": col == F.col("c_isin") + 1, "industry": col == F.col("c_industry"),
             "pct": col == F.col("c_pct"), "mv": col == F.col("c_market_value")}
    bits = {part: 1 << i for i, part in enumerate(parts)}
    beside, numeric = bits["left_name"] | bits["right_name"], bits["pct"] | bits["mv"]
    near = (col == F.col("c_isin") - 1) | (col == F.col("c_isin") + 1)
    roles = reduce(Column.__add__, (F.when(is_part, bits[part]).otherwise(0) for part, is_part in parts.items()))
    roles = F.when(near & ~F.coalesce(usable, F.lit(False)), roles.bitwiseAND(~beside)).otherwise(roles)

    def has(mask: int) -> Column:
        return F.col("roles").bitwiseAND(mask) != 0

    # what a cell is to its row is settled before rows are put together: sorted are a word of roles, a text and a number
    number = F.when((col == F.col("c_pct")) | (col == F.col("c_market_value")), F.coalesce(F.col("num"), feeds.number(text)))
    cast = body.select(*SHEET, "row_idx", roles.alias("roles"), "text", number.alias("number"))
    values = {part: F.col("number") if bits[part] & numeric else text for part in parts}
    # rows of a task are sorted by the first key: the names of files and sheets hardly differ in their first letters
    rows = cast.groupBy(F.xxhash64(*SHEET, "row_idx").alias("row_hash"), *SHEET, "row_idx").agg(
        *(F.max(F.when(has(bits[part]), value)).alias(part) for part, value in values.items()))
    return (rows.filter(names.is_isin(F.col("isin")))
                .withColumn("name", F.coalesce("own_name", "left_name", "right_name")).filter(F.col("name").isNotNull())
                .select(*SHEET, "row_idx", "name", "isin", "industry", "pct", "mv"))


def scaled_lines(lines: DataFrame) -> DataFrame:
    """Weights in percent: a sheet whose weights (up to 100) total at most 3 holds
    fractions. A weight over 100 after scaling is junk and dropped; a missing one
    is 0. Market value goes from lakh to crore."""
    totals = lines.groupBy(*SHEET).agg(F.sum(F.when(F.col("pct") <= 100, F.col("pct"))).alias("total"))
    scale = F.when((F.col("total") > 0) & (F.col("total") <= 3), 100.0).otherwise(1.0)
    return (lines.join(totals.hint("shuffle_hash"), SHEET)
            .select(*SHEET, "row_idx", names.clean_instrument(F.col("name")).alias("instrument_name"), "isin",
                    names.clean_sector(F.col("industry")).alias("sector"),
                    F.coalesce(rnd(F.col("pct") * scale, 4), F.lit(0.0)).alias("pct_of_aum"),
                    rnd(F.col("mv") / 100, 2).alias("market_value_cr"))
            .filter(F.col("pct_of_aum") <= 100))


def unreadable(cells: DataFrame, header_scan_rows: int | None = None) -> DataFrame:
    """(file, sheet, reason) of sheets with no header, or with a header that lacks a column."""
    headers = header_rows(cells, header_scan_rows)
    every, mapped = cells.select(*SHEET).distinct(), column_map(cells, headers).select(*SHEET, F.lit(True).alias("mapped"))
    reason = F.when(F.col("header").isNull(), "no header row").when(F.col("mapped").isNull(), "header lacks a column")
    return every.join(headers, SHEET, "left").join(mapped, SHEET, "left").select(*SHEET, reason.alias("reason")).filter(F.col("reason").isNotNull())


def parse_sheets(cells: DataFrame, as_of: str, header_scan_rows: int | None = None, date_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sheets, lines): title facts with the weight total of every sheet, and its
    holding lines. A sheet without a date gets ``as_of``. Scans go down to the header,
    wherever it is, unless the depths are given; ``unreadable`` lists the rest."""
    headers = settle(header_rows(cells, header_scan_rows), "headers")
    deepest = headers.agg(F.max("header")).first()[0]
    # no sheet reaches further, so hardly a cell is looked up
    upper = cells.filter(F.col("row_idx") <= F.lit(deepest).cast("bigint"))
    top = settle(upper.join(headers.hint("shuffle_hash"), SHEET).filter(F.col("row_idx") <= F.col("header")).select(*cells.columns), "top-cells")
    # cells met their sheets by (file, sheet), so the lines lie so, for their totals and all that asks for a sheet's lines
    lines = scaled_lines(settle_by(sheet_lines(cells, settle(column_map(top, headers), "columns")), "sheet-lines", *SHEET, placed=True))
    totals = lines.groupBy(*SHEET).agg(F.sum("pct_of_aum").alias("total_pct"), F.count(F.lit(1)).alias("lines"))
    sheets = (sheet_titles(title_rows(top, headers), as_of, date_rows).join(totals, SHEET)
              .filter(F.coalesce("scheme_name", F.lit("")) != "")
              .withColumn("as_of_date", F.coalesce("as_of_date", F.lit(as_of).cast("date"))))
    return settle(sheets, "sheets"), lines


def unparsed(cells: DataFrame, sheets: DataFrame, lines: DataFrame, header_scan_rows: int | None = None) -> DataFrame:
    """(file, sheet, reason) of the landed sheets that are not among the parsed ``sheets``: unreadable, without a valid line, or
    without a name above their lines."""
    left = settle(cells.select(*SHEET).distinct().join(sheets.select(*SHEET).hint("shuffle_hash"), SHEET, "left_anti"), "left-sheets")
    cells = settle(cells.join(left.hint("shuffle_hash"), SHEET, "left_semi"), "left-cells")
    some = lines.select(*SHEET).distinct().withColumn("some", F.lit(True))
    reason = F.coalesce("reason", F.when(F.col("some").isNull(), "no valid line").otherwise("no scheme name"))
    return left.join(unreadable(cells, header_scan_rows), SHEET, "left").join(some, SHEET, "left").select(*SHEET, reason.alias("reason"))


def plausible(sheets: DataFrame) -> DataFrame:
    return sheets.filter(F.col("total_pct") <= K.MAX_PORTFOLIO_WEIGHT)


def suspect(sheets: DataFrame) -> DataFrame:
    """Sheets whose weights total more than a fund can hold: quarantined whole."""
    return sheets.filter(F.col("total_pct") > K.MAX_PORTFOLIO_WEIGHT)
