"""License statements and notices in documents by conditional compression, confirmed word for word.

The words around each licensing word, as many as the longest template could take up there, are candidates, whatever lines
and paragraphs they stand on. A block of them is compressed with every template that enough of them occur in as raw
zstandard dictionary. In the order of the bytes saved the templates are aligned with the block, and the first that enough
of its words confirm, in order, gives its statements. Each statement is then a block of its own: of the templates that
confirm it, the one that saves most bytes of it wins. What lies between statements is ranked again.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.license_texts import TEMPLATES

# Words that make their surroundings a candidate (fixed values); between words may be anything but a word.
TRIGGER = (r"(?i)licen[cs]e|copyright|permission[\W_]+(?:is[\W_]+hereby|to[\W_]+use)|redistribut|public[\W_]+domain|warrant(?:y|ies)"
           r"|creative[\W_]+commons")
LEAST_SHARE = 0.8  # of a template's words must be there, in order
REACHES = 8  # a block holds this many times the words of the longest statement; two of them are read again with the next block
KEPT_CHARS = 8192  # sizes of blocks up to this length are kept for the next equal one, 2,048 blocks at most

FOUND = ("doc_id BIGINT, license STRING, start INT, end INT, reduction DOUBLE, n_missing INT, n_extra INT, exact BOOLEAN")

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_TRIGGER = re.compile(TRIGGER)


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(9, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class _Templates:
    """The templates' words as numbers, how many of them a statement may lack or have besides, and their compressors."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in templates]
        wordings = [_words(text) for _, text in templates]
        self.numbers = {w: i for i, w in enumerate(sorted({w for words in wordings for w in words}))}
        self.rows = [np.array([self.numbers[w] for w in words], np.int64) for words in wordings]
        self.counts = np.stack([np.bincount(r, minlength=len(self.numbers)) for r in self.rows])
        sizes = [len(w) for w in wordings]
        self.least = np.array([-(-round(LEAST_SHARE * 100) * n // 100) for n in sizes], np.int64)
        self.most_extra = [(100 - round(LEAST_SHARE * 100)) * n // 100 + 1 for n in sizes]
        self.reach = max((n + extra for n, extra in zip(sizes, self.most_extra)), default=0)
        self.plain = zstandard.ZstdCompressor(compression_params=_parameters())
        self.with_template = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                                       compression_params=_parameters()) for words in wordings]
        self.kept = lru_cache(2048)(self._sizes)

    def possible(self, numbers: np.ndarray) -> tuple[int, ...]:
        """Templates with enough words in the block, in any order: no other can be confirmed there."""
        there = np.bincount(numbers[numbers >= 0], minlength=len(self.numbers))
        return tuple(np.flatnonzero(np.minimum(self.counts, there).sum(1) >= self.least).tolist())

    def _sizes(self, block: str, which: tuple[int, ...]) -> tuple[int, list[int]]:
        data = block.encode("utf-8", "replace")
        return len(self.plain.compress(data)), [len(self.with_template[t].compress(data)) for t in which]

    def sizes(self, block: str, which: tuple[int, ...]) -> tuple[int, list[int]]:
        """The compressed size of a block, and with each of the templates as dictionary."""
        return self.kept(block, which) if len(block) <= KEPT_CHARS else self._sizes(block, which)


_known = lru_cache(4)(_Templates)


def reductions(block: str, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[float]:
    """Per template, the share of the compressed size of the block's words (lower case, one space between) that it saves."""
    plain, sizes = _known(templates).sizes(" ".join(_words(block)), tuple(range(len(templates))))
    return [(plain - size) / plain for size in sizes]


def _regions(text: str, known: _Templates) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number, start, end) of the words that a statement with a licensing word could hold, run by run."""
    triggers = (m.span() for m in _TRIGGER.finditer(text))
    trigger = next(triggers, None)
    recent: deque[tuple[int, int, int]] = deque(maxlen=known.reach)
    run, left, gap = (array("q"), array("q"), array("q")), 0, 0

    def add(word: tuple[int, int, int]) -> None:
        for r, x in zip(run, word):
            r.append(x)

    for m in _WORD.finditer(text):
        word = (known.numbers.get(m.group().lower(), -1), m.start(), m.end())
        hit = False
        while trigger and trigger[0] < word[2]:
            hit = True
            if trigger[1] > word[2]:
                break
            trigger = next(triggers, None)
        if hit:
            if gap > known.reach and run[0]:
                yield tuple(np.array(r, np.int64) for r in run)
                run = (array("q"), array("q"), array("q"))
            for w in recent:
                add(w)
            recent.clear()
            left, gap = known.reach + 1, 0
        if left:
            add(word)
            left -= 1
        elif not trigger:
            break
        else:
            recent.append(word)
            gap += 1
    if run[0]:
        yield tuple(np.array(r, np.int64) for r in run)


_ONE = 1 << 32  # a differing word, above the place where an alignment starts


class _Block:
    """The numbers of a block's words, and where each of them stands."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.order = np.argsort(numbers, kind="stable")
        self.sorted = numbers[self.order]
        self.at = np.arange(len(numbers) + 1, dtype=np.int64)

    def aligned(self, row: np.ndarray, least: int, most_extra: int) -> list[tuple[int, int, int, int]]:
        """(first word, end word, missing, extra) of a template's statements that do not overlap, those with the fewest
        differing words first.

        The template is aligned with the words that end at each place so that the fewest words differ; of equally good ones
        the shortest counts. A step takes one word of the template against all places, held less one differing word a place,
        so that running past words of the text is a running minimum."""
        n, size, at = len(self.numbers), len(row), self.at
        lows, highs = np.searchsorted(self.sorted, row, "left").tolist(), np.searchsorted(self.sorted, row, "right").tolist()
        state = n - at - at * _ONE
        for low, high in zip(lows, highs):
            skipped = state + _ONE
            if low < high:
                hit = self.order[low:high]
                skipped[hit + 1] = np.minimum(skipped[hit + 1], state[hit] - _ONE)
                np.minimum.accumulate(skipped, out=skipped)
            state = skipped
        state += at * _ONE
        differing, start = state >> 32, n - (state & (_ONE - 1))
        same = (size + at - start - differing) // 2
        extra = at - start - same
        good = np.flatnonzero((same >= least) & (extra <= most_extra))
        good = good[(good > 0) & (self.numbers[good - 1] >= 0)]  # no statement ends in a foreign word
        taken, out = np.zeros(n, bool), []
        for j in good[np.lexsort((start[good], (differing - same)[good]))].tolist():
            low = int(start[j])
            if not taken[low:j].any():
                taken[low:j] = True
                out.append((low, j, size - int(same[j]), int(extra[j])))
        return out


def _statements(text: str, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: _Templates) -> list[tuple[int, int, int, int, int, float]]:
    """(first word, end word, template, missing, extra, reduction) of the statements in a block, which do not overlap."""
    words = [text[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())]

    def confirmed(low: int, high: int, have: tuple[int, list] | None = None) -> tuple[int, list[tuple[int, int, int, int]]]:
        """The template that saves most bytes of these words among those that they confirm, and its statements; of templates
        that save the same, the one with the fewest differing words. ``have`` is a template confirmed before."""
        which = known.possible(numbers[low:high])
        if which:
            block = _Block(numbers[low:high])

            def spans(t: int) -> list[tuple[int, int, int, int]]:
                return [(low + a, low + b, *d) for a, b, *d in block.aligned(known.rows[t], int(known.least[t]), known.most_extra[t])]

            small = known.sizes(" ".join(words[low:high]), which)[1]
            for _, tied in groupby(sorted(zip(small, which)), key=lambda x: x[0]):
                found = [(a[0][2] + a[0][3], t, a) for _, t in tied if (a := have[1] if have and t == have[0] else spans(t))]
                if found:
                    return min(found)[1:]
        return -1, []

    out, todo = [], [(0, len(numbers))]
    while todo:
        low, high = todo.pop()
        t, spans = confirmed(low, high)
        spans.sort()
        edges = [low]
        for i, span in enumerate(spans):
            # ranked with as many words around it as it lacks, which another template may explain, then on its own words
            around = max(span[0] - span[2], edges[-1]), min(span[1] + span[2], spans[i + 1][0] if i + 1 < len(spans) else high)
            winner, (best, *_) = confirmed(*around, (t, [span]))
            winner, ((a, b, missing, extra), *_) = confirmed(*best[:2], (winner, [best]))
            plain, (size,) = known.sizes(" ".join(words[a:b]), (winner,))
            out.append((a, b, winner, missing, extra, (plain - size) / plain))
            edges += [a, b]
        if spans:
            edges.append(high)
            todo += [(x, y) for x, y in zip(edges[::2], edges[1::2]) if y > x and _TRIGGER.search(text, int(starts[x]), int(ends[y - 1]))]
    return sorted(out)


def find(text: str, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[str, int, int, float, int, int]]:
    """(license, start, end, reduction, missing words, extra words) of each statement, left to right. Long runs of candidate
    words are read in blocks; a statement counts in the block that holds it and all that could overlap it."""
    known = _known(templates)
    out = []
    for numbers, starts, ends in _regions(text, known):
        at, n = 0, len(numbers)
        while at < n:
            end = min(n, at + REACHES * known.reach)
            sure = n if end == n else end - 2 * known.reach
            following = sure
            for low, high, t, missing, extra, share in _statements(text, numbers[at:end], starts[at:end], ends[at:end], known):
                if at + low < sure:
                    out.append((known.names[t], int(starts[at + low]), int(ends[at + high - 1]), share, missing, extra))
                    following = max(following, at + high)
            at = following
    return sorted(out, key=lambda f: f[1])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, start, end, reduction, n_missing, n_extra, exact): a row per statement found, with its code
    points (end exclusive), the share of its words' compressed size that the template saved, and how many words differ. Line breaks,
    empty lines and marks between the words do not count.

    Null and empty texts and texts without a licensing word have no rows. Ids may be null or repeat; equal rows give
    equal rows. Other columns are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *f, f[4] + f[5] == 0) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in find(text, templates)]
            columns = list(zip(*rows)) or [()] * 8
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["doc_id", "license", "start", "end", "reduction", "n_missing", "n_extra", "exact"])

    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(TRIGGER))
    return some.mapInArrow(run, FOUND)
