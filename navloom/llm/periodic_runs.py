"""Periodic runs of words: stretches that repeat themselves with a period, and texts with each run cut to its first period.

A word that equals the one q words before it lengthens the match on diagonal q by one, and a diagonal that ends after
enough matches is a run. Followed for every earlier occurrence of every word, this grows with the square of a text. A run
of smallest period q has at least 2q matches on its diagonal, so diagonals are followed in grams instead of words, for
the lags up to 16 in grams of 16 words, for those up to 32 in grams of 32, and so on. Of a gram's earlier occurrences only
the nearest can be on a run's diagonal: if a gram as long as the period came again inside the run at a smaller lag, that
lag would be a period of all of the run. For the same reason a diagonal of nearest occurrences has no smaller period. So a
text of n words takes n diagonal steps for each of about log2(n / 24) ranges of lags, even if it is one word over and over.

Steps are taken for all words of a piece of texts at once: a step's match length is one more than that of the word before
if that one was on the same diagonal, and where the diagonal changes the one before ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from navloom.llm.textwords import byte_column, mix, roll, row_pieces, word_bounds, word_hashes

LEAST_LENGTH = 24  # words of a run
LEAST_PERIODS = 3  # how often a run holds its period
PIECE = 1 << 21  # bytes of texts worked on at once; a longer text is worked on alone

_RUN = ("start", "length", "period")
_OF_TEXT = np.uint64(0x9E3779B97F4A7C15)  # parts equal grams of different texts


def _nearest(words: np.ndarray, text: np.ndarray, gram: int) -> np.ndarray:
    """For each place that a gram starts at, how far back the nearest equal gram of its text starts; 0 where none does."""
    keys = roll(words, gram)
    lag = np.zeros(len(keys), np.int64)
    at = np.flatnonzero(text[gram - 1:] == text[:len(keys)])
    keys = mix(keys[at] + text[at].astype(np.uint64) * _OF_TEXT)
    order = np.argsort(keys, kind="stable")
    again = keys[order[1:]] == keys[order[:-1]]
    later, earlier = at[order[1:][again]], at[order[:-1][again]]
    lag[later] = later - earlier
    return lag


def find_runs(words: np.ndarray, bounds: np.ndarray, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, end, period) of the maximal runs among word hashes, by start, then period. `bounds` parts the texts, which no
    run crosses; `least_periods` is 3 or more."""
    if least_periods < 3:
        raise ValueError("a run holds its period three times or more")
    sizes = np.diff(bounds)
    text, longest = np.repeat(np.arange(len(sizes)), sizes), int(sizes.max(initial=0))
    found = [np.empty((0, 3), np.int64)]
    # every run has so many matches on its diagonal, whatever its period
    low, high = 1, min(max(least_length - q, (least_periods - 1) * q) for q in range(1, least_length + 1))
    while max(least_length, least_periods * low) <= longest:
        lag = _nearest(words, text, high)
        ends = np.append(np.flatnonzero(np.diff(lag)) + 1, len(lag))
        begins = np.append(0, ends[:-1])
        period = lag[begins]
        start, end = begins - period, ends + high - 1
        run = (period >= low) & (period <= high) & (end - start >= np.maximum(least_length, least_periods * period))
        found.append(np.stack([start, end, period], 1)[run])
        low, high = high + 1, 2 * high
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _collapsed(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space: their bytes, and the white space byte before all but a text's
    first made a space."""
    held = np.concatenate([[0], np.cumsum(kept)])
    begins = starts[kept]
    joined = np.ones(len(begins), bool)
    joined[held[first[:-1]][held[first[1:]] > held[first[:-1]]]] = False
    begins = begins - joined
    steps = np.zeros(len(data) + 1, np.int8)
    np.add.at(steps, begins, 1)
    np.add.at(steps, ends[kept], -1)
    inside = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    out = data.copy()
    out[begins[joined]] = 0x20
    offsets = np.concatenate([[0], np.cumsum(inside)])[bounds].astype(np.int32)
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets), pa.py_buffer(out[inside]))


def _of_texts(column: pa.Array, least_length: int, least_periods: int) -> list[pa.Array]:
    data, bounds = byte_column(column)
    starts, ends, sizes = word_bounds(data, bounds)
    first = np.concatenate([[0], np.cumsum(sizes)])
    found = find_runs(word_hashes(data, starts, ends), first, least_length, least_periods)
    text = np.searchsorted(first, found[:, 0], "right") - 1
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 1], -1)
    kept = np.cumsum(steps[:-1]) == 0
    parts = [pa.array(a) for a in (found[:, 0] - first[text], found[:, 1] - found[:, 0], found[:, 2])]
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32)), pa.StructArray.from_arrays(parts, list(_RUN)))
    return [pa.array(sizes.astype(np.int64)), runs, _collapsed(data, bounds, starts, ends, first, kept)]


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least_length: int = LEAST_LENGTH,
                  least_periods: int = LEAST_PERIODS) -> DataFrame:
    """The `keep` columns of every row with `n_words`, `runs` as (start, length, period) in words from 0, by start, then
    period, and `collapsed`, the text without the words that any run holds after its first period, joined by single spaces.

    Words are what stands between white space, compared as they are. A run is maximal, has `least_length` words or more
    and holds its smallest period `least_periods` times or more; runs may overlap. A null, empty or blank text has no words, no
    runs and an empty `collapsed`. Each row stands alone, so repeated rows and ids or null ids do not matter. Other columns
    are left out; a kept column that has one of the new names is an error."""
    if {"n_words", "runs", "collapsed"} & set(keep):
        raise ValueError("n_words, runs or collapsed is among the kept columns")
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    run = StructType([StructField(name, LongType()) for name in _RUN])
    schema = StructType([*rows.schema.fields[1:], StructField("n_words", LongType()), StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_pieces(batch, PIECE):
                found = _of_texts(piece.column(0), least_length, least_periods)
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], *found], names=schema.names)

    return rows.mapInArrow(work, schema).withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})
