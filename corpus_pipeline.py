"""A corpus from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.llm import decontamination, language_id, packing, secret_scan, sketch_dedup
from navloom.llm.rows import join_rows

LEAST_SCORE = 0.1  # share of a language's n-grams below which a text of some length is in no known language
LEAST_CHARS = 20  # shorter texts are rejected only when they have no letter


def _unused(names: list[str], name: str) -> str:
    while name in names:
        name = f"_{name}"
    return name


def _rows(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, text_hash, row): what rows are joined by, and all their columns in one, whatever they are called."""
    return docs.select("doc_id", F.xxhash64(F.col("text") if text is None else text).alias("text_hash"), F.struct(*docs.columns).alias("row"))


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language learned from the labels; those without a letter, or with hardly an
    n-gram of any language, go, and so do longer texts in a language or script that no row is labelled with. If no row
    has a label, no language is known and every text with a letter stays."""
    names = docs.columns
    lang, score = _unused(names, "lang_pred"), _unused(names, "score")
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model, keep=tuple(names), lang_col=lang, score_col=score)
    return found.where((F.col(lang) != "und") & ((F.col(score) >= LEAST_SCORE) | (F.length("text") < LEAST_CHARS))).select(*names)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates, of its rows the one with the least text hash. Rows that share an
    id but not their text are documents of their own; of rows with equal id and text one stays. Rows with a null id all
    stay."""
    rows = _rows(docs.where("doc_id IS NOT NULL"))
    keyed = rows.select("doc_id", "text_hash", F.xxhash64("doc_id", "text_hash").alias("key"), F.col("row.text").alias("text"))
    group = sketch_dedup.near_duplicates(keyed, id_col="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    first = (keyed.select("key", "doc_id", "text_hash").distinct().join(group, "key")
             .groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*"))
    kept = join_rows(rows, first, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage of ten words (or a whole shorter item) with the benchmark."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("n_hit > 0").select("doc_id", "text_hash").distinct()
    return join_rows(_rows(docs), hit, "left_anti").select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret span replaced by a mark."""
    found = secret_scan.scan(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    rows = join_rows(_rows(docs, F.coalesce("text", F.lit(""))), found, "left")
    hit, text = F.col("spans").isNotNull(), F.col("row.text")
    clean = F.when(hit, secret_scan.redacted(text, F.col("spans"))).otherwise(text)
    changed = {"text": clean, "n_chars": F.when(hit, F.length(clean).cast("long")).otherwise(F.col("row.n_chars"))}
    return rows.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.best_fit(packing.word_counts(docs))


STAGES = [("language ID", in_known_language), ("MinHash near-dedup", one_of_each_group), ("benchmark decontamination", without_benchmark),
          ("secret scans", without_secrets), ("best-fit packing", packed)]
ORACLE_SQL = None  # language prediction and best-fit packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each over all that the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
