"""Guarded conversions of feed values, and dates written as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions.rounding import rnd

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_FULL_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august",
                "september", "october", "november", "december"]
_OTHER_MONTHS = ["", "", "", "", "", "", "", "", "sept", "", "", ""]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to ``value``, which is computed once however often used."""
    return F.transform(F.array(value), use)[0]


def number(text: Column) -> Column:
    """A finite number, or null."""
    v = F.trim(text.cast("string")).try_cast("double")
    # not-a-number compares above infinity
    return F.when(F.abs(v) < float("inf"), v)


def plausible_ter(text: Column) -> Column:
    """An expense ratio in (0, 3], else null."""
    return let(number(text), lambda v: F.when((v > 0) & (v <= K.MAX_PLAUSIBLE_TER), rnd(v, 4)))


def lakh_to_crore(text: Column) -> Column:
    return let(number(text), lambda v: F.when(v > 0, rnd(v / 100, 2)))


def month_number(word: Column) -> Column:
    """1-12 for a whole month name or its abbreviation, else null."""
    w = F.lower(word)
    found = F.greatest(*(F.array_position(F.array(*map(F.lit, names)), w) for names in (_MONTHS, _FULL_MONTHS, _OTHER_MONTHS)))
    return F.nullif(found, F.lit(0)).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    y = year.try_cast("int")
    y = F.when((y < 69) & (F.length(year) <= 2), y + 2000).when(F.length(year) <= 2, y + 1900).otherwise(y)
    text = F.format_string("%04d-%02d-%02d", y, month, day.try_cast("int"))
    return F.when(y.isNotNull() & month.isNotNull(), text.try_cast("date"))


_SEP = "\u0001"


def _if_fields(text: Column, pattern: str, then: Callable[[Column], Column], otherwise: Column | None = None) -> Column:
    """``then`` of the three groups of ``pattern``, found in one pass, where the
    whole text matches."""
    parts = F.split(F.regexp_replace(text, f"(?is)^{pattern}$", f"$1{_SEP}$2{_SEP}$3"), _SEP)
    other = F.lit(None).cast("date") if otherwise is None else otherwise
    return let(parts, lambda p: F.when(F.size(p) == 3, then(p)).otherwise(other))


def text_date(text: Column) -> Column:
    """A day-first or month-name date ('25-Aug-2026', '30 June 2026',
    'June 30,2026', '2026-08-25', '25/08/2026'), else null."""
    def parsed(t: Column) -> Column:
        iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date"))
        digits = _if_fields(t, r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", lambda p: _date(p[2], p[1].try_cast("int"), p[0]), iso)
        month_first = _if_fields(t, r"([A-Za-z]+)\s+(\d{1,2}),?\s*(\d{4})", lambda p: _date(p[2], month_number(p[0]), p[1]), digits)
        return _if_fields(t, r"(\d{1,2})[-\s/]([A-Za-z]+)[-\s/,]*(\d{2,4})", lambda p: _date(p[2], month_number(p[1]), p[0]), month_first)

    return let(F.trim(text), parsed)


def as_on_date(text: Column) -> Column:
    """The date of an 'as on <date>' wording inside a text, else null."""
    return text_date(F.regexp_extract(text, K.AS_ON_PATTERN, 1))


def period_end(label: Column) -> Column:
    """'April - June 2026' -> 2026-06-30: last day of the last full month name
    in the first year; null when either is missing."""
    year = F.regexp_extract(label, r"(\d{4})", 1).try_cast("int")
    months = F.filter(F.regexp_extract_all(F.lower(label), F.lit("([a-z]+)"), F.lit(1)),
                      lambda w: w.isin(_FULL_MONTHS))
    month = F.array_position(F.array(*map(F.lit, _FULL_MONTHS)), F.try_element_at(months, F.lit(-1))).cast("int")
    return F.when(year.isNotNull() & (F.size(months) > 0), F.last_day(F.make_date(year, month, F.lit(1))))


def link_date(url: Column) -> Column:
    """The date in a workbook link, written '30th-June-2026' or 'June-30,-2026';
    the first wording that fits decides."""
    month_first = _if_fields(url, K.LINK_MONTH_FIRST_PATTERN, lambda p: _date(p[2], month_number(p[0]), p[1]))
    return _if_fields(url, K.LINK_DAY_FIRST_PATTERN, lambda p: _date(p[2], month_number(p[1]), p[0]), month_first)
