"""Byte strings that a smaller id has too, found through a logarithmic family of sorted suffix tables.

Blocks of documents, ascending by id, are the batches. Only suffixes that may belong to a long match enter: the
least `GRAM`-byte hash of a window (its minimizer) must occur a second time somewhere. A batch's suffixes, cut to
the match length, are sorted and merge-scanned against the levels that stand; what no level has is added as a new
level, and levels of like size merge, so that there are as many as the logarithm of the batches. Only equality to
the match length is asked, so the tables are sorted by a 64-bit digest of each suffix's first `length` bytes, and
dealt into ranges by a second digest: every range keeps a family of its own and all ranges run at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from navloom.llm import blocks as B
from navloom.llm.textwords import PIECE, byte_values, mix, roll, sliding_min
from navloom.session import settle

KEPT = "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, removed ARRAY<STRUCT<start: INT, end: INT>>, kept BINARY"


class Levels:
    """Sorted tables of distinct keys, each at least twice as large as the next."""

    def __init__(self, tables: list[np.ndarray] = ()):
        self.tables = list(tables)

    def scan(self, batch: np.ndarray) -> np.ndarray:
        """Which keys of a sorted batch does some level hold? Both sides ascend, so the look-ups walk forward."""
        found = np.zeros(len(batch), bool)
        for table in self.tables:
            at = np.searchsorted(table, batch)
            at[at == len(table)] = 0
            found |= table[at] == batch
        return found

    def add(self, batch: np.ndarray) -> None:
        """A new level; while the one above isn't twice as large, the two merge."""
        if not len(batch):
            return
        self.tables.append(batch)
        while len(self.tables) > 1 and len(self.tables[-2]) < 2 * len(self.tables[-1]):
            last = self.tables.pop()
            both = np.concatenate([self.tables.pop(), last])
            both.sort(kind="stable")  # two ascending runs: a merge
            self.tables.append(both)


def seen_before(batches: list[np.ndarray]) -> list[np.ndarray]:
    """Per batch, in order, and key: does an earlier batch hold it?"""
    levels, out = Levels(), []
    for batch in batches:
        found = levels.scan(batch)
        levels.add(batch[~found])
        out.append(found)
    return out


class _Suffixes:
    """The suffixes of a block that may start a long match."""

    def __init__(self, block: B.Block, side: pa.Table, length: int, gram: int):
        self.block, self.length, self.gram = block, length, gram
        self.copied = block.copied(side)
        starts = np.arange(0, max(0, len(block.data) - length + 1), PIECE)
        self.pieces = [(int(s), min(int(s) + PIECE, len(block.data) - length + 1)) for s in starts]

    def _open(self, low: int, high: int) -> np.ndarray:
        """Starts from low to high whose window lies in one text that is no copy."""
        at = np.arange(low, high)
        row = np.searchsorted(self.block.bounds, at, "right") - 1
        return (at + self.length <= self.block.bounds[row + 1]) & ~self.copied[row]

    def _minima(self, low: int, high: int) -> np.ndarray:
        data = self.block.data[low:high + self.length - 1]
        return sliding_min(mix(roll(byte_values(data), self.gram)), self.length - self.gram + 1)

    def anchors(self, parts: int) -> tuple[B.Packed, list[tuple[np.ndarray, np.ndarray]]]:
        """The windows' minimizers: one for each run of neighbouring windows that share it. Beside them, per
        piece, the open starts and which run each belongs to."""
        keys, places, total = [], [], 0
        for low, high in self.pieces:
            minima = self._minima(low, high)
            at = np.flatnonzero(self._open(low, high))
            found = minima[at]
            new = np.ones(len(at), bool)
            new[1:] = (found[1:] != found[:-1]) | (at[1:] != at[:-1] + 1)
            keys.append(found[new])
            places.append((at + low, np.cumsum(new) - 1 + total))
            total += int(new.sum())
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        keys = mix(keys)  # minima crowd at small values
        packed = B.Packed((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int32))
        return packed, places

    def suffixes(self, parts: int, side: pa.Table) -> tuple[np.ndarray, B.Packed]:
        packed, places = self.anchors(parts)
        repeated = (B.Packed.answers(side, "anchors") | (packed.counts > 1))[packed.inverse] if len(packed.inverse) else np.zeros(0, bool)
        starts, keys, others = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for (low, high), (at, run) in zip(self.pieces, places):
            at = at[repeated[run]]
            if len(at):
                data = self.block.data[low:high + self.length - 1]
                starts.append(at)
                keys.append(mix(roll(byte_values(data), self.length)[at - low]))
                others.append((mix(roll(byte_values(data, 1), self.length, 1)[at - low]) % np.uint64(parts)).astype(np.int32))
        return np.concatenate(starts), B.Packed(np.concatenate(keys), np.concatenate(others))


def _send_anchors(parts: int, length: int, gram: int):
    def send(block: int, rows: B.Block, side: pa.Table) -> pa.Table:
        return _Suffixes(rows, side, length, gram).anchors(parts)[0].rows(block)
    return send


def _send_suffixes(parts: int, length: int, gram: int):
    def send(block: int, rows: B.Block, side: pa.Table) -> pa.Table:
        return _Suffixes(rows, side, length, gram).suffixes(parts, side)[1].rows(block)
    return send


def _remove(parts: int, length: int, gram: int):
    def remove(block: int, rows: B.Block, side: pa.Table) -> pa.Table:
        s = _Suffixes(rows, side, length, gram)
        starts, packed = s.suffixes(parts, side)
        if len(starts):
            ids = rows.ids[np.searchsorted(rows.bounds, starts, "right") - 1]
            starts = starts[B.Packed.answers(side, "suffixes")[packed.inverse] | (ids > packed.first(ids))]
        edges = np.zeros(len(rows.data) + 1, np.int32)
        edges[starts] += 1
        np.add.at(edges, starts + length, -1)
        gone = np.cumsum(edges, dtype=np.int32)[:-1] > 0
        n_removed, removed, kept = [], [], []
        for i, (a, b) in enumerate(zip(rows.bounds[:-1].tolist(), rows.bounds[1:].tolist())):
            if s.copied[i] and b - a >= length:
                spans, rest = [(0, b - a)], b""
            elif gone[a:b].any():
                off = gone[a:b]
                step = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]])))
                spans, rest = step.reshape(-1, 2).tolist(), rows.data[a:b][~off].tobytes()
            else:
                spans, rest = [], rows.data[a:b].tobytes()
            removed.append([{"start": x, "end": y} for x, y in spans])
            n_removed.append(b - a - len(rest))
            kept.append(rest)
        return pa.table({"doc_id": rows.id_values, "n_bytes": pa.array(rows.sizes.astype(np.int64)), "n_removed": pa.array(n_removed, pa.int64()),
                         "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                         "kept": pa.array(kept, pa.binary())})
    return remove


def remove_shared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int | None = None,
                  block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Each document without the bytes of strings of `length` bytes that also start in a document with a smaller
    id. Strings are judged on the input. `removed` has the maximal removed byte ranges, `kept` the other bytes.

    Texts are UTF-8 bytes; matches never cross documents. A null or empty text has no bytes. A null id sorts last.
    Rows that share an id never remove from each other. Other columns are left out. `gram` (three fifths of `length`
    by default) is the length of the minimizer that a long match must share."""
    gram = gram or max(1, length * 3 // 5)
    laid, parts = B.lay_out(docs, id_col, text_col, block_bytes)
    side = settle(B.copies(laid), "copies")
    anchors = B.ask(B.per_block(laid, side, _send_anchors(parts, length, gram), B.KEYS), np.uint32, B.elsewhere)
    side = side.unionByName(B.as_side(settle(anchors, "anchors"), "anchors"))
    suffixes = B.ask(B.per_block(laid, side, _send_suffixes(parts, length, gram), B.KEYS), np.uint64, seen_before)
    side = side.unionByName(B.as_side(settle(suffixes, "suffixes"), "suffixes"))
    return B.per_block(laid, side, _remove(parts, length, gram), KEPT)
