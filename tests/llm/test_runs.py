import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from navloom.llm import periodic_runs
from tests.llm.conftest import ODD, table, words


def slow_runs(seq, least_length=24, least_periods=3):
    """Every stretch of every period, extended as far as it goes, whose smallest period it is."""
    out = set()
    for q in range(1, len(seq) // least_periods + 1):
        i = q
        while i < len(seq):
            if seq[i] != seq[i - q]:
                i += 1
                continue
            j = i
            while j < len(seq) and seq[j] == seq[j - q]:
                j += 1
            start, length = i - q, j - i + q
            part = seq[start:j]
            if length >= max(least_length, least_periods * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.add((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_collapsed(seq, runs):
    drop = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(seq) if i not in drop)


def found_in(texts, **kw):
    values = np.array([hash(w) % 2**63 for t in texts for w in t], np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out = [[] for _ in texts]
    for a, b, q in periodic_runs.find_runs(values, bounds, **kw).tolist():
        t = int(np.searchsorted(bounds, a, "right")) - 1
        out[t].append((a - bounds[t], b - a, q))
    return out


block = st.lists(st.integers(0, 3), min_size=1, max_size=12)
texts = st.lists(st.lists(st.tuples(block, st.integers(1, 9)), max_size=6).map(lambda parts: [w for b, k in parts for w in b * k]), min_size=1, max_size=4)


@settings(max_examples=400, deadline=None)
@given(texts, st.sampled_from([(24, 3), (6, 3), (10, 4), (2, 3)]))
def test_runs_equal_every_diagonal(found, least):
    assert found_in(found, least_length=least[0], least_periods=least[1]) == [slow_runs(t, *least) for t in found]


def test_words_of_fibonacci_and_doubling(spark):
    a, b = "a", "ab"
    for _ in range(13):
        a, b = b, b + a
    twice = "a"
    for _ in range(9):
        twice += twice.translate(str.maketrans("ab", "ba"))
    for t in (b, twice, "a" * 700, ("a" * 20 + "b") * 30, ("ab" * 12 + "c") * 9 + "ab" * 12):
        assert found_in([list(t)]) == [slow_runs(list(t))]
        assert found_in([list(t)], least_length=4) == [slow_runs(list(t), 4)]


def test_long_text_of_one_word_takes_no_square(spark):
    n = 1_000_000
    assert periodic_runs.find_runs(np.full(n, 7, np.uint64), np.array([0, n])).tolist() == [[0, n, 1]]


@pytest.mark.parametrize("piece", [50, 1 << 21])
def test_texts_of_all_kinds(spark, monkeypatch, piece):
    monkeypatch.setattr(periodic_runs, "PIECE", piece)
    rows = [(i, " ".join(words(i, 40))) for i in range(10)]
    rows += [(50, "la " * 100), (51, "\t a b\nc " * 9), (52, "x y " * 12 + " ".join(words(1, 30)) + " x y" * 20), (53, "Ä ä " * 20), (54, " ".join(words(9, 20) * 4 + words(8, 9)))]
    rows += ODD + [rows[0], (50, "la " * 100)]
    found = periodic_runs.periodic_runs(table(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found if r.doc_id is not None) == sorted(
        (False, i, len((t or "").split()), tuple(slow_runs((t or "").split())), slow_collapsed((t or "").split(), slow_runs((t or "").split()))) for i, t in rows if i is not None)
    assert sum(r.doc_id is None for r in found) == 2


def test_empty_table_and_clashing_names(spark):
    df = table(spark, [])
    assert periodic_runs.periodic_runs(df).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df.withColumnRenamed("kept", "runs"), keep=("doc_id", "runs"))
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(3, np.uint64), np.array([0, 3]), least_periods=2)
