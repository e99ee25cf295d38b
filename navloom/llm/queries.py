"""The registered queries of this package: opN_<name> over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.llm import (decontamination, fingerprints, language_id, license_scan, merkle_manifest, packing, periodic_runs, secret_scan, sketch_dedup,
                         substring_dedup, suffix_dedup, toxicity, warc)
from navloom.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_dedup(spark, sf_dir):
    return sketch_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query
def op2_best_fit_packing(spark, sf_dir):
    return packing.best_fit(packing.word_counts(table(spark, sf_dir, "documents")))


@query
def op3_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op5_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints_beside_edits(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))


@query
def op7_suffix_dedup(spark, sf_dir):
    kept = suffix_dedup.remove_shared(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op9_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


@query
def op10_warc(spark, sf_dir):
    root = scratch_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), root)
    return warc.read_archives(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out), corpus=docs)
    found = toxicity.score(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("evidence.id").alias("evidence"))


@query
def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = merkle_manifest.leaf_digest([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in names])
    found = merkle_manifest.manifest(docs, names, carry={"tampered": F.when(touched, tampered)})
    folded = merkle_manifest.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _with_repeats(text, doc_id):
    """The text, for every tenth id with its words from some place on replaced by repeats of the first of them."""
    crc = F.crc32(doc_id.cast("string"))
    g = F.floor(crc / 10)

    def repeated(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    edited = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return F.when(crc % 10 == 0, F.coalesce(edited, text)).otherwise(text)


@query
def op13_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", _with_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.periodic_runs(docs).withColumn("runs", F.coalesce("runs", F.array()))
    most = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    listed = F.transform("runs", lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
                         F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "most.start", "most.length", "most.period",
                        F.floor(1000 * F.col("most.length") / F.col("most.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
