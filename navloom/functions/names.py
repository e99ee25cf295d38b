"""Text functions over scheme, house and instrument names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from navloom import constants as K


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(text, F.lit(" \t\r\n\f\v"))


def _first_match(text: Column, patterns: dict[str, str]) -> Column:
    """The first label whose pattern the text has, else null."""
    return F.coalesce(*(F.when(text.rlike(pattern), label) for label, pattern in patterns.items()))


def plan_type(name: Column) -> Column:
    """Direct or Regular, else null; Direct wins when both words appear."""
    return _first_match(name, K.PLAN_PATTERNS)


def option_type(name: Column) -> Column:
    """IDCW (payout wordings first) or Growth, else null."""
    return _first_match(name, K.OPTION_PATTERNS)


def fund_group_id(amc: Column, name: Column) -> Column:
    """One id for all plan and option variants of a fund."""
    base = F.regexp_replace(F.lower(name), rf"(?i)\b({K.GROUP_ID_WORDS})\b", " ")
    key = F.concat(F.trim(F.lower(_blank(amc))), F.lit("|"), F.regexp_replace(base, "[^a-z0-9]+", ""))
    return F.substring(F.md5(key), 1, 16)


def sub_category(category: Column) -> Column:
    """The text after the first ' - ' of a category, else null."""
    return F.when(category.contains(" - "), F.trim(F.regexp_extract(category, "(?s)^.*? - (.*)$", 1)))


def is_isin(value: Column) -> Column:
    return F.coalesce(strip(value).rlike(K.ISIN_PATTERN), F.lit(False))


def clean_sector(industry: Column) -> Column:
    """Footnote marks dropped; empty is cash, a credit rating is debt."""
    s = strip(F.regexp_replace(_blank(industry), "[#*^~]+", ""))
    return (F.when(s == "", "Cash & Equivalents")
             .when(s.rlike(K.RATING_PATTERN), "Debt / Money Market").otherwise(s))


def clean_instrument(name: Column) -> Column:
    """Trailing footnote marks dropped."""
    return F.regexp_replace(strip(name), r"[\s$~#*^@]+$", "")


def _words(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.lower(_blank(text)), "[^a-z0-9]+", " "), " ")
    return F.filter(parts, lambda w: (w != "") & ~w.isin(K.JOIN_WORDS))


def name_tokens(text: Column) -> Column:
    """Lower-case words without punctuation and join words."""
    return F.array_join(_words(text), " ")


def master_identity(name: Column) -> Column:
    """A master name reduced to its fund: the words before 'Fund' plus the words
    after it that do not merely describe a plan or option."""
    raw = F.regexp_replace(_blank(name), r"\(.*?\)", " ")
    head = _words(F.regexp_extract(raw, K.FUND_SPLIT_PATTERN, 1))
    tail = F.filter(_words(F.regexp_extract(raw, K.FUND_SPLIT_PATTERN, 2)), lambda w: ~w.isin(K.PLAN_WORDS))
    plain = name_tokens(F.regexp_replace(raw, K.MASTER_STRIP_PATTERN, " "))
    return F.when(raw.rlike(r"(?i)\bfunds?\b"), F.array_join(F.concat(head, tail), " ")).otherwise(plain)


def sheet_identity(name: Column) -> Column:
    """A portfolio-sheet title reduced to its fund, keeping plan words, which
    belong to the fund's own name there."""
    return name_tokens(F.regexp_replace(_blank(name), K.SHEET_STRIP_PATTERN, " "))


def house_key(name: Column) -> Column:
    """Matching key of a fund house."""
    s = F.regexp_replace(F.lower(_blank(name)), "[^a-z0-9]+", " ")
    return F.trim(F.replace(s, F.lit(" mutual fund"), F.lit("")))
