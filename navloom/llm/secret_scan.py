"""Secrets in documents, with ownership frequency over the whole corpus; DataFrame functions only.

Three base patterns find keyed values, access keys and hex digests. Long mixed tokens are candidates beside them: the
corpus tells how many repositories and owners hold each value, and a value that belongs to few owners and looks
drawn at random is taken for a live credential, while one that many owners copied is an example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.llm.rows import join_rows
from navloom.session import settle

# Base patterns (fixed values); the least lengths are checked after matching, as failing matches are used up too.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ANY = "|".join((r"(?i:passw|secret|token|api_?key)", ACCESS, HEX, TOKEN))
KINDS = ("assign", "access", "hex", "live")  # in the order in which equal starts are listed

MAX_OWNERS = 2  # a value of more owners is an example
LEAST_KINDS_OF_CHARACTERS = 10  # a random-looking value has at least so many different ones

PARTS = "array<struct<gap: int, whole: int, value: string>>"


def _parts(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Matches, left to right, as (gap, whole, value): the characters since the one before, its own, and what counts."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if value_group else values
    gaps = F.transform(F.split(text, pattern, -1), F.length)  # one more than matches
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("whole"), values.alias("value"))
    return F.when(text.rlike(pattern), parts).otherwise(F.array()).cast(PARTS)


def _placed(scanned: DataFrame) -> DataFrame:
    """A row per match with its start and end: running lengths over the row's matches of one kind, so that a text takes
    time in proportion to its matches."""
    kinds = scanned.select("row", "doc_id", "owner", "text_hash", F.posexplode("found").alias("kind", "parts"))
    parts = kinds.select("row", "doc_id", "owner", "text_hash", "kind", F.posexplode("parts").alias("nth", "part"))
    parts = parts.select("row", "doc_id", "owner", "text_hash", "kind", "nth", "part.*").where("value IS NOT NULL")
    before = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("whole")).over(before).cast("int")
    placed = parts.withColumn("end", end).withColumn("start", F.col("end") - F.col("whole"))
    least = F.when(F.col("kind") == 0, 8).otherwise(1)
    return placed.where(F.length("value") >= least).drop("gap", "whole", "nth")


def _apart(spans: DataFrame) -> DataFrame:
    """Base spans, and the tokens of letters and digits that touch none: before a token's start no base span reaches over
    it, and the next one starts at its end or later."""
    base = F.col("kind") < 3
    up = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("reach", F.max(F.when(base, F.col("end"))).over(up)).withColumn("next", F.min(F.when(base, F.col("start"))).over(down))
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    return spans.where(base | (mixed & free)).drop("reach", "next")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """(doc_id, text_hash, spans) per row of docs: spans are (start, kind, end, value, owners, repositories), by start
    and kind, in code points with the end exclusive; kind is a place in KINDS. Base spans all stay; `live` ones are
    tokens that touch no base span, hold letters, digits and many different characters, and belong to
    at most `max_owners` owners.

    An owner is a value of `owner_col` (null counts as one), a repository a document id. Null and empty texts have
    no spans. Ids may be null or repeat: a row is known by id and text. Other columns are left out."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), text.alias("text"))
    patterns = ((ASSIGN, 1), (ACCESS, 0), (HEX, 0), (TOKEN, 0))
    found = F.when(F.col("text").rlike(ANY), F.array(*(_parts(F.col("text"), p, group) for p, group in patterns)))
    scanned = settle(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", F.xxhash64("text").alias("text_hash"), found.alias("found")), "matches")

    each = settle(_apart(_placed(scanned)).withColumn("value_hash", F.sha2("value", 256)), "spans")
    owners = each.groupBy("value_hash", "owner").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.count("*").alias("owners"))
    places = each.groupBy("value_hash", "doc_id").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.count("*").alias("repositories"))
    spread = settle(owners.join(places, "value_hash"), "owners")
    each = each.join(spread, "value_hash")
    random = F.size(F.array_distinct(F.split("value", ""))) >= LEAST_KINDS_OF_CHARACTERS
    kept = each.where((F.col("kind") < 3) | (random & (F.col("owners") <= max_owners)))
    spans = kept.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "value", "owners", "repositories"))).alias("spans"))
    return join_rows(scanned.select("doc_id", "text_hash"), spans, "left").select(
        "doc_id", "text_hash", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of touching or overlapping spans replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(F.lit(0), s["start"] - done["at"]))
        out = F.when((s["start"] > done["at"]) | (done["out"] == ""), F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
