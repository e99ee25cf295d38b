"""Repeated word sequences, found through difference-cover anchors.

Anchors of `k` words are hashed only where the position modulo a period lies in a difference cover: for any two
positions some shift below the period brings both into the cover, so any two equal windows of `words` =
period + k - 1 words share an anchor at the same place inside. Anchors that occur once are dropped. Around the
others the match is extended: each window that holds a repeated anchor is compared, over its whole length, with
the earlier ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from navloom.llm import blocks as B
from navloom.llm.textwords import mix, roll, word_bounds, word_hashes
from navloom.session import settle

# Period and perfect difference cover of it (fixed values).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}

KEPT = "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, removed ARRAY<STRUCT<start: INT, end: INT>>, kept BINARY"


def period_for(words: int) -> int:
    """The longest period that leaves anchors of at least two fifths of the window."""
    return max(p for p in COVERS if p == 1 or words - p + 1 >= 0.4 * words)


class _Windows:
    """The words of a block, its anchors and the windows that may repeat."""

    def __init__(self, block: B.Block, side: pa.Table, words: int):
        self.block, self.words = block, words
        self.starts, self.ends, self.counts = word_bounds(block.data, block.bounds)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.copied = block.copied(side)
        self.row = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        self.at = np.arange(len(self.row)) - self.first[self.row]
        self.left = self.counts[self.row] - self.at  # words from here to the end of the text
        self.hashes = word_hashes(block.data, self.starts, self.ends)
        self.open = ~self.copied[self.row] & (self.counts[self.row] >= words)

    def anchors(self, parts: int) -> tuple[np.ndarray, B.Packed]:
        period = period_for(self.words)
        k = self.words - period + 1
        cover = np.zeros(period, bool)
        cover[list(COVERS[period])] = True
        at = np.flatnonzero(cover[self.at % period] & (self.left >= k) & self.open)
        keys = mix(roll(self.hashes, k)[at])
        return at, B.Packed((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int32))

    def windows(self, parts: int, side: pa.Table) -> tuple[np.ndarray, B.Packed]:
        """Starts of windows around a repeated anchor, and the keys of their words."""
        at, packed = self.anchors(parts)
        repeated = (B.Packed.answers(side, "anchors") | (packed.counts > 1))[packed.inverse] if len(at) else np.zeros(0, bool)
        period = period_for(self.words)
        edges = np.zeros(len(self.row) + period + 1, np.int32)
        hit = at[repeated]
        np.add.at(edges, hit + 1, -1)
        np.add.at(edges, np.maximum(hit - period + 1, self.first[self.row[hit]]), 1)
        starts = np.flatnonzero((np.cumsum(edges)[:len(self.row)] > 0) & (self.left >= self.words) & self.open)
        second = word_hashes(self.block.data, self.starts, self.ends, seed=1)
        keys, other = (mix(roll(h, self.words, seed)[starts]) for seed, h in ((0, self.hashes), (1, second)))
        return starts, B.Packed(keys, (other % np.uint64(parts)).astype(np.int32))


def _send_anchors(parts: int, words: int):
    def send(block: int, rows: B.Block, side: pa.Table) -> pa.Table:
        return _Windows(rows, side, words).anchors(parts)[1].rows(block)
    return send


def _send_windows(parts: int, words: int):
    def send(block: int, rows: B.Block, side: pa.Table) -> pa.Table:
        return _Windows(rows, side, words).windows(parts, side)[1].rows(block)
    return send


def earlier(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Per block, in order, and key: does an earlier block hold it?"""
    every = np.concatenate(keys)
    block = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    _, first, inverse = np.unique(every, return_index=True, return_inverse=True)
    return np.split(block > block[first][inverse], np.cumsum([len(k) for k in keys])[:-1])


def _remove(parts: int, words: int):
    def remove(block: int, rows: B.Block, side: pa.Table) -> pa.Table:
        w = _Windows(rows, side, words)
        starts, packed = w.windows(parts, side)
        before = np.zeros(0, bool)
        if len(starts):
            ids = rows.ids[w.row[starts]]
            before = B.Packed.answers(side, "windows")[packed.inverse] | (ids > packed.first(ids))
            # the same words earlier in the same row
            order, row = packed.order, w.row[starts]
            again = np.zeros(len(starts), bool)
            again[1:] = ~packed.new[1:] & (row[order][1:] == row[order][:-1])
            before[order] |= again
        edges = np.zeros(len(w.row) + 1, np.int32)
        edges[starts[before]] += 1
        np.add.at(edges, starts[before] + words, -1)
        gone = np.cumsum(edges)[:-1] > 0
        gone |= w.copied[w.row] & (w.counts[w.row] >= words)
        n_removed = np.bincount(w.row[gone], minlength=len(w.counts))
        removed, kept = [], []
        for i, text in enumerate(rows.text(j) for j in range(len(w.counts))):
            found = bytes(text).split()
            if n_removed[i]:
                off = gone[w.first[i]:w.first[i + 1]]
                step = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]])))
                removed.append([{"start": a, "end": b} for a, b in step.reshape(-1, 2).tolist()])
                found = [f for f, g in zip(found, off.tolist()) if not g]
            else:
                removed.append([])
            kept.append(b" ".join(found))
        return pa.table({"doc_id": rows.id_values, "n_words": pa.array(w.counts.astype(np.int64)),
                         "n_removed": pa.array(n_removed.astype(np.int64)),
                         "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                         "kept": pa.array(kept, pa.binary())})
    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 20,
                   block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Each document without the words of windows that also start earlier: in a smaller id, or before in the same
    text. Windows are judged on the input. `kept` has the remaining words joined by one space, in UTF-8, `removed`
    the removed word ranges.

    Words are runs without ASCII white space. A null or empty text has no words. A null id sorts last. Rows that
    share an id are texts of their own, and none is earlier than the other. Repeated rows are so many result rows.
    Other columns are left out. Windows are compared by 64-bit hashes inside ranges dealt by a second hash."""
    laid, parts = B.lay_out(docs, id_col, text_col, block_bytes)
    side = settle(B.copies(laid), "copies")
    anchors = B.ask(B.per_block(laid, side, _send_anchors(parts, words), B.KEYS), np.uint32, B.elsewhere)
    side = side.unionByName(B.as_side(settle(anchors, "anchors"), "anchors"))
    windows = B.ask(B.per_block(laid, side, _send_windows(parts, words), B.KEYS), np.uint64, earlier)
    side = side.unionByName(B.as_side(settle(windows, "windows"), "windows"))
    return B.per_block(laid, side, _remove(parts, words), KEPT)
