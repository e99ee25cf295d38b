"""The daily price file: ';'-separated rows in sections.

A line with fewer than six fields is context: a section ('... Schemes ( ... )')
sets type and category, any other names the fund house. Scheme rows have six or
eight fields and take the context above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions import names
from navloom.functions.feeds import number, text_date
from navloom.operators.carry import carry_forward


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, pos, line) of landed text files. A block is a scan split, so a
    file of any size is read and filled in parallel."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Scheme rows of (file, block, pos, line), with their section and house."""
    text = lines.select("file", "block", "pos", names.strip(F.col("line")).alias("line")).filter(F.col("line") != "")
    fields = F.split("line", ";")
    context = F.size(fields) < 6
    section = F.col("line").rlike(K.SECTION_PATTERN)
    marked = text.select(
        "file", "block", "pos", F.when(~context, fields).alias("fields"),
        F.when(context & section, F.col("line")).alias("section"),
        F.when(context & ~section, F.col("line")).alias("amc"))
    rows = carry_forward(marked, ["section", "amc"]).filter(names.strip(F.col("fields")[0]).rlike("^[0-9]+$"))

    def field(i: int) -> Column:
        return names.strip(F.get("fields", F.lit(i)))

    def filled(i: int) -> Column:
        return F.when(~field(i).isin("", "-"), field(i))

    wide = F.size("fields") >= 8
    plan_source, option_source = F.when(wide, field(4)).otherwise(field(3)), F.when(wide, field(5)).otherwise(field(3))
    category = F.when(F.col("section").isNotNull(), names.strip(F.regexp_extract("section", K.SECTION_PATTERN, 2)))
    return rows.select(
        field(0).alias("scheme_code"), F.coalesce(filled(1), filled(2)).alias("isin"), field(3).alias("name"),
        number(F.when(wide, field(6)).otherwise(field(4))).alias("nav"),
        text_date(F.when(wide, field(7)).otherwise(field(5))).alias("nav_date"),
        F.when(F.col("section").isNotNull(), names.strip(F.regexp_extract("section", K.SECTION_PATTERN, 1))).alias("scheme_type"),
        category.alias("category"), names.sub_category(category).alias("sub_category"), "amc",
        names.plan_type(plan_source).alias("plan_type"), names.option_type(option_source).alias("option_type"),
        names.fund_group_id(F.col("amc"), field(3)).alias("fund_group_id"))
