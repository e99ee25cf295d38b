"""Language identification with bit-sliced Bloom filters of n-grams.

Each slot of the filter holds a bit mask of languages. Fitting sets a language's bit in the slots of its frequent
n-grams; looking an n-gram up takes the AND of its slots and so answers for all languages at once. A text's score
for a language is the number of its n-grams that have the language's bit, less what the language's share of set
slots lets through by chance, over the number of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from navloom.llm.textwords import LOWER, byte_column, byte_values, mix, roll

SLOTS = 1 << 18  # a power of two; with a 64-bit word per 64 languages, the filter has 2 MB
HASHES = 2
GRAM_BYTES = (3, 4, 5)
PER_LANGUAGE = 5_000  # labelled documents that a language is learned from, at most
MAX_LANGUAGES = 1000  # labels that `fit` takes unless told otherwise; bounds what it broadcasts and keeps per language
STEP = 1024  # documents looked up at once
GRAM_PIECE = 1 << 19  # bytes whose n-grams are worked on at once
HELD_GRAMS = 2_000_000  # counts that a task holds before it gives them out
COMMON = 2e-5  # an n-gram enters a language's filter at this share of the language's n-grams

# ASCII letters and all bytes of longer code points count as letters; the rest parts n-grams.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[0x61:0x7B] = True
IS_LETTER[0x80:] = True


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    masks: np.ndarray  # (SLOTS, words of 64 languages)
    chance: np.ndarray  # per language: share of absent n-grams that the filter has all the same


def grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams inside runs of letters, a space standing for each edge, and their rows; a piece of the
    bytes at a time, each with the few bytes after it that its last n-grams reach into."""
    for low in range(0, len(data), GRAM_PIECE):
        high = min(low + GRAM_PIECE, len(data))
        piece = LOWER[data[low:high + max(GRAM_BYTES) - 1]]
        letter = IS_LETTER[piece]
        piece = np.where(letter, piece, np.uint8(0x20))
        row = (np.searchsorted(bounds, np.arange(low, low + len(piece)), "right") - 1).astype(np.int32)
        values = byte_values(piece)
        for size in GRAM_BYTES:
            n = min(high - low, len(piece) - size + 1)
            if n <= 0:
                continue
            inner = row[:n] == row[size - 1:size - 1 + n]
            for j in range(1, size - 1):
                inner &= letter[j:n + j]
            yield mix(roll(values, size)[:n][inner] + np.uint64(size)), row[:n][inner]


def slots(keys: np.ndarray) -> list[np.ndarray]:
    return [((keys >> np.uint64(24 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts by language, added up inside the task and given out when they are many."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for name, (found, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column(1).to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(lang) for lang in langs], np.int64)
        for keys, rows in grams(*byte_column(batch.column(0))):
            own = code[rows]
            for i, name in enumerate(names):
                found, counts = np.unique(keys[own == i], return_counts=True)
                if name in held:
                    both, place = np.unique(np.concatenate([held[name][0], found]), return_inverse=True)
                    total = np.zeros(len(both), np.int64)
                    np.add.at(total, place, np.concatenate([held[name][1], counts]))
                    held[name] = (both, total)
                elif len(found):
                    held[name] = (found, counts.astype(np.int64))
            if sum(len(found) for found, _ in held.values()) > HELD_GRAMS:
                yield from out()
    yield from out()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, order: Column | None = None,
        max_languages: int = MAX_LANGUAGES) -> Model:
    """Learns from at most `per_language` documents of each language, those least in `order` (a hash of the text
    by default). Null or empty texts and null languages teach nothing. The driver gets the filter, whose size is
    fixed for a number of languages; n-grams are counted and chosen by tasks. More than `max_languages` labels are an
    error, not a cut: none is left out in silence."""
    labelled = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    draw = F.pmod(order if order is not None else F.xxhash64("text"), F.lit(1 << 20))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size")).limit(max_languages + 1).toPandas()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found = sorted(sizes["lang"])
    if not found:
        return Model((), np.zeros((SLOTS, 1), np.uint64), np.zeros(0))
    sizes = docs.sparkSession.createDataFrame(sizes, "lang STRING, size BIGINT")
    # a share of the hash range that holds about per_language documents, so that no group is sorted
    sample = labelled.join(F.broadcast(sizes), "lang").where(draw < F.lit(per_language) / F.col("size") * (1 << 20)).select("text", "lang")
    counts = sample.mapInArrow(_counted, "lang STRING, gram BIGINT, n BIGINT").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    common = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.greatest(F.lit(2), F.lit(COMMON) * F.col("total")))
    positions = [F.shiftrightunsigned("gram", 24 * i).bitwiseAND(F.lit(SLOTS - 1)).cast("int") for i in range(HASHES)]
    rows = common.select("lang", F.explode(F.array(*positions)).alias("slot")).distinct()
    # at most SLOTS short rows a language, as bit strings
    packed = rows.groupBy("lang").agg(F.collect_set("slot").alias("slots")).toPandas()
    masks = np.zeros((SLOTS, (len(found) + 63) // 64 or 1), np.uint64)
    for lang, taken in zip(packed["lang"], packed["slots"]):
        i = found.index(lang)
        masks[np.array(taken, np.int64), i // 64] |= np.uint64(1 << (i % 64))
    fill = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(found))])
    return Model(tuple(found), masks, fill**HASHES)


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    data, bounds = byte_column(column)
    n = len(bounds) - 1
    total, hits = np.zeros(n), np.zeros((n, max(1, len(model.languages))))
    for keys, rows in grams(data, bounds):
        hit = None
        for slot in slots(keys):
            masks = model.masks[slot]
            hit = masks if hit is None else hit & masks
        total += np.bincount(rows, minlength=n)
        for i in range(len(model.languages)):
            bit = (hit[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[:, i] += np.bincount(rows, bit.astype(np.float64), n)
    chance = np.append(model.chance, 0.0)[:hits.shape[1]]
    scores = np.clip((hits / np.maximum(total, 1)[:, None] - chance) / np.maximum(1e-9, 1 - chance), 0, 1)
    best = scores.argmax(1)
    letters = IS_LETTER[LOWER[data]]
    ascii_ = np.concatenate([[0], np.cumsum(letters & (data < 0x80))])
    some = ascii_[bounds[1:]] > ascii_[bounds[:-1]]
    for i in np.flatnonzero(~some):  # no ASCII letter: look at the characters
        some[i] = any(c.isalpha() for c in data[bounds[i]:bounds[i + 1]].tobytes().decode("utf-8", "replace"))
    some &= len(model.languages) > 0
    score = np.where(some, scores[np.arange(n), best], 0.0)
    return [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist())], score


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), lang_col: str = "lang_pred",
             score_col: str = "score") -> DataFrame:
    """The `keep` columns with `lang_col` and `score_col` for each row. Equal texts get equal answers. A null text, or one
    without a letter, is `und` with score 0; so is every text if no language was learned. Among languages of equal
    score the first by name is taken. The score is the corrected share of n-grams found, from 0 to 1. Other columns are
    left out; a kept column that has one of the new names is an error."""
    if {lang_col, score_col} & set(keep):
        raise ValueError(f"{lang_col} or {score_col} is among the kept columns")
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    schema = StructType([*(StructField(f"_{i}", f.dataType) for i, f in enumerate(rows.schema.fields[1:])),
                         StructField(lang_col, StringType()), StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                names, score = predict(model_.value, part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})
