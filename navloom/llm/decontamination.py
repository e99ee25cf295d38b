"""Benchmark passages in training documents, by winnowed fingerprints; DataFrame functions only.

Of every window of `words` words only the least hash of its k-grams is kept, so any two equal windows keep the same
one. Documents that share a kept hash with the benchmark are extended: their windows, word for word, are joined
with the benchmark's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.llm.rows import join_rows
from navloom.session import settle

# What parts words: everything in ASCII but digits and letters (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """A-Z lower-cased, nothing else: `lower` does the same, and faster, on a text that is all ASCII."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _windows(words: Column, length: int) -> Column:
    """The windows' words, joined by a space."""
    starts = F.sequence(F.lit(1), F.size(words) - (length - 1))
    made = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, length)))
    return F.when(F.size(words) >= length, made).otherwise(F.array().cast("array<string>"))


def _placed(words: Column, length: int) -> Column:
    return F.transform(_windows(words, length), lambda w, i: F.struct(i.alias("start"), (i + length).alias("end"), w.alias("window")))


def _gram(length: int, full: int) -> int:
    return (length + 1) // 2 if length == full else length


def _hashes(words: Column, k: int) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(F.size(words) >= k, made).otherwise(F.array().cast("array<bigint>"))


def _kept(hashes: Column, span: int) -> Column:
    """The least hash of every `span` neighbours, each once."""
    if span == 1:
        return F.array_distinct(hashes)
    made = F.transform(F.sequence(F.lit(1), F.size(hashes) - (span - 1)), lambda i: F.array_min(F.slice(hashes, i, span)))
    return F.array_distinct(F.when(F.size(hashes) >= span, made).otherwise(F.array().cast("array<bigint>")))


def _fingerprints(table: DataFrame, lengths: list[int], full: int) -> DataFrame:
    """Adds `prints`: winnowed hashes of the `words` column for each window length."""
    grams = {n: _gram(n, full) for n in lengths}
    for k in sorted(set(grams.values())):
        table = table.withColumn(f"_h{k}", _hashes(F.col("words"), k))
    parts = [_kept(F.col(f"_h{k}"), n - k + 1) for n, k in grams.items()]
    return table.withColumn("prints", F.concat(*parts)).drop(*(f"_h{k}" for k in grams.values()))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", words: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items) per row of docs: how many words lie inside an occurrence of a
    window of the benchmark, and the ids, as sorted strings, of the items with such windows.

    A window has `words` words; a benchmark item of fewer, but not none, is one window. Null or empty texts have no
    words. A null item id hits, but isn't listed. Ids may be null or repeat: a row is known by id and text, and rows
    equal in both get equal results. Other columns are left out."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col).cast("string")).alias("words")).where(F.size("words") > 0)
    items = settle(items.withColumn("length", F.least(F.size("words"), F.lit(words))), "items")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # from 1 to `words` at most
    if not lengths:
        return docs.select("doc_id", "text_hash", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                           F.array().cast("array<string>").alias("items"))

    windows, prints = [], []
    for n in lengths:
        own = items.where(F.col("length") == n)
        windows.append(own.select("item", F.explode(_windows(F.col("words"), n)).alias("window")))
        prints.append(_fingerprints(own, [n], words).select(F.explode("prints").alias("print")))
    for more in (windows, prints):
        while len(more) > 1:
            more.append(more.pop().unionByName(more.pop()))
    windows, prints = settle(windows[0].distinct(), "windows"), settle(prints[0].distinct(), "prints")

    scanned = docs.withColumn("words", words_of(F.col("text")))
    scanned = _fingerprints(scanned, lengths, words).select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "prints")
    scanned = settle(scanned, "fingerprints")
    found = scanned.select("doc_id", "text_hash", F.explode("prints").alias("print")).join(prints, "print", "left_semi")
    found = found.select("doc_id", "text_hash").distinct()

    extended = join_rows(docs, found, "left_semi").withColumn("words", words_of(F.col("text")))
    spans = F.concat(*(_placed(F.col("words"), n) for n in lengths))
    spans = extended.select("doc_id", "text_hash", F.explode(spans).alias("s")).select("doc_id", "text_hash", "s.*")
    wanted = settle(windows.select("window").distinct(), "wanted")  # plain sides, so that a window many have can be split
    hits = settle(spans.join(wanted, "window", "left_semi"), "hits")

    # words covered: spans by start, each adding what lies beyond the end reached so far
    cover = F.aggregate(F.array_sort(F.collect_set(F.struct("start", "end"))), F.struct(F.lit(0).alias("reached"), F.lit(0).cast("long").alias("n")),
                        lambda a, s: F.struct(F.greatest(a["reached"], s["end"]).alias("reached"),
                                              (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["reached"], s["start"]))).alias("n")))["n"]
    covered = hits.groupBy("doc_id", "text_hash").agg(cover.alias("n_hit"))
    named = (hits.select("doc_id", "text_hash", "window").distinct().join(windows, "window").select("doc_id", "text_hash", "item").distinct()
             .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items")))
    scanned = join_rows(scanned, join_rows(covered, named, "inner"), "left")
    return scanned.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                          F.coalesce("items", F.array().cast("array<string>")).alias("items"))
