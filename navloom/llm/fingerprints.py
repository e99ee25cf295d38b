"""Document fingerprints from closed syncmers.

A k-mer is chosen when the least hash among its s-mers stands at one of its two edges. The choice looks at the k-mer
alone, so equal passages choose equal k-mers wherever they stand, and an edit disturbs only the k-mers over it.
A fingerprint keeps, for each of a fixed number of bins of the hash range, a few bits of the least hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.ranges import even_ranges, in_range
from navloom.llm.textwords import byte_column, byte_values, mix, roll, sliding_min
from navloom.session import settle

K, S = 24, 13  # bytes of a k-mer and of the s-mers inside
BINS = 64  # four hex digits each
RANGE_BYTES = 4 << 20
STEP = 128  # documents fingerprinted at once


def syncmers(data: np.ndarray, bounds: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start byte, hash) of each closed syncmer, by row and start. A text shorter than k, but not empty, has
    one: itself."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    inner = mix(roll(byte_values(data), s))
    span = k - s + 1
    least = sliding_min(inner, span)
    n = len(least)
    at = np.flatnonzero((least == inner[:n]) | (least == inner[span - 1:span - 1 + n]))
    at = at[row[at] == row[at + k - 1]] if n else at
    keys = mix(roll(byte_values(data, 1), k, 1)[at]) if n else np.zeros(0, np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        own = np.array([int.from_bytes(hashlib.blake2b(data[bounds[i]:bounds[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short], np.uint64)
        rows, starts, keys = np.concatenate([row[at], short]), np.concatenate([at, bounds[short]]), np.concatenate([keys, own])
        order = np.argsort(rows, kind="stable")
        rows, starts, keys = rows[order], starts[order], keys[order]
    else:
        rows, starts = row[at], at
    return rows, starts - bounds[rows], keys


def sketches(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of 16-bit values per text; 0 marks a bin without syncmers."""
    rows, _, keys = syncmers(data, bounds)
    least = np.full((len(bounds) - 1) * BINS, 2**64 - 1, np.uint64)
    np.minimum.at(least, rows * BINS + (keys % np.uint64(BINS)).astype(np.int64), keys)
    out = (mix(least) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    out[least == 2**64 - 1] = 0
    return out.reshape(-1, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins that either fills in which both are equal; 1 for two empty texts."""
    filled = ((a > 0) | (b > 0)).sum(1)
    return np.where(filled > 0, ((a == b) & (a > 0)).sum(1) / np.maximum(filled, 1), 1.0)


def as_text(sketch: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sketch]


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


ANCHORS = "doc_id BIGINT, position INT, anchor BIGINT"


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, anchor): the closed syncmers with their starts in UTF-8 bytes, for positional matching.
    A null or empty text has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                rows, starts, keys = syncmers(*byte_column(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(starts.astype(np.int32)), pa.array(keys.view(np.int64))],
                                                 names=["doc_id", "position", "anchor"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ANCHORS)


def matches(docs: DataFrame, other: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, other_id, shift, n): passages that documents share with `other` ones, as anchors at one shift of
    positions. Anchors that stand in many documents give as many rows: meant for a set of queries."""
    a = anchors(docs, id_col, text_col)
    b = anchors(other, id_col, text_col).select(F.col("doc_id").alias("other_id"), F.col("position").alias("other_position"), "anchor")
    return a.join(b, "anchor").groupBy("doc_id", "other_id", (F.col("other_position") - F.col("position")).alias("shift")).agg(F.count("*").alias("n"))


PRINTS = ("doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE")


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, each range's own rows in order and then the row that follows its last."""
    held: tuple | None = None
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
        if held is not None:
            rows = [held, *rows]
        for at in range(0, len(rows) - 1, STEP):
            yield from _compared(rows[at:at + STEP + 1])
        held = rows[-1] if rows else held


def _compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    texts = [(r[3] or "") for r in rows]
    own = [t.encode() for t in texts]
    pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
    if not pairs:
        return
    edited = []
    for i in pairs:
        half = len(texts[i]) // 2
        edited.append((texts[i][:len(texts[i]) - half] + texts[i + 1][:half]).encode())
    sketch, new = sketches(*_buffer(own)), sketches(*_buffer(edited))
    at = np.array(pairs)
    yield pa.RecordBatch.from_arrays([
        pa.array([rows[i][2] for i in pairs], pa.int64()), pa.array([len(texts[i]) for i in pairs], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(as_text(sketch[at])), pa.array(as_text(new)),
        pa.array(likeness(sketch[at], new)), pa.array(likeness(sketch[at], sketch[at + 1]))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints_beside_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row: its fingerprint, that of an edited text, and how alike fingerprints are. The edited text has the last
    floor(n / 2) code points replaced by the first as many (or all) of the next document's, in descending order of
    ids; after the last comes the first.

    A null text is empty, an empty text has an empty fingerprint, and two empty texts are alike. A null id comes
    last; rows of one id are ordered by a hash of their text, and rows equal in both stand together. A single row
    is its own next. Other columns are left out.

    Rows are dealt into id ranges of bounded size; the first row of a range is copied behind the range before it,
    so that each range is read alone, in order, and texts move once."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    light = settle(docs.select("doc_id", "tie", F.octet_length("text").cast("long").alias("size")), "sizes")
    bounds = even_ranges(light.where("doc_id IS NOT NULL"), "doc_id", "size", range_bytes) or [0]
    # ranges count up as ids go down; null ids have the last
    spread = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(F.lit(len(bounds) - 1) - in_range(F.col("doc_id"), bounds))
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-2**63)), "tie")
    heads = light.withColumn("range", spread).groupBy("range").agg(F.max(order).alias("head"), F.max("doc_id").isNull().alias("nulls")).collect()  # a row per range
    heads = sorted(heads, key=lambda r: r["range"])
    before = [(None if r["nulls"] else r["head"][0], r["head"][1], heads[i - 1]["range"]) for i, r in enumerate(heads)]
    before = settle(docs.sparkSession.createDataFrame(before, "head_id BIGINT, head_tie BIGINT, before INT"), "heads")
    joined = docs.withColumn("range", spread).join(before, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")))).otherwise(
        F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("range"), F.lit(True).alias("extra"))))
    rows = joined.select("doc_id", "text", "tie", F.explode(places).alias("p")).select("p.range", "p.extra", "doc_id", "text", "tie")
    rows = rows.repartition(len(heads) or 1, "range").sortWithinPartitions("range", "extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return rows.select("range", "extra", "doc_id", "text").mapInArrow(_beside, PRINTS)
