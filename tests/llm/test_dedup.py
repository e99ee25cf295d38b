import hashlib

import numpy as np
import pyarrow as pa
import pytest

from navloom.llm import blocks, sketch_dedup, substring_dedup, suffix_dedup
from navloom.llm.components import components
from tests.llm.conftest import multiset, table, words


def shingles(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def groups(rows, n, percent):
    """Brute force over all pairs; rows of one id are one document."""
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, corpus, n):
    found = multiset(sketch_dedup.near_duplicates(table(spark, corpus), words=n), "doc_id", "n_shingles", "component_id", "kept")
    root = groups(corpus, n, 80)
    expected = [(i, len(shingles(t, n)), None if i is None else root[i], True if i is None else root[i] == i) for i, t in corpus]
    assert found == sorted(expected, key=repr)


def test_near_duplicates_chain_through_a_mixed_bucket(spark):
    """A chain whose ends are unlike: every link must be found, whatever node a bucket compares first."""
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(15):
        w = list(base)
        for j in range(i * 2):
            w[j] = f"new{j}"
        rows.append((i * 7 % 15, " ".join(w)))
    found = dict(multiset(sketch_dedup.near_duplicates(table(spark, rows), words=1), "doc_id", "component_id"))
    assert found == groups(rows, 1, 80)
    assert set(found.values()) == {0}


def test_tiles_are_bounded_in_nodes(spark, monkeypatch):
    """Short sets fill a tile with nodes long before it is full of shingles."""
    def counting(percent):
        def count(table):
            few = table.column("few").to_pylist()
            return pa.table({"a": pa.array([sum(few)], pa.int64()), "b": pa.array([len(few) - sum(few)], pa.int64())})
        return count

    monkeypatch.setattr(sketch_dedup, "_joining", counting)
    placed = spark.range(5000).selectExpr("1L AS bucket", "id AS node", "id AS root", "3L AS n_shingles")
    sets = spark.range(5000).selectExpr("id AS node", "array(1L, 2L, id + 10) AS shingles")
    found = multiset(sketch_dedup._tiled(placed, sets, 80), "a", "b")
    assert len(found) > 1 and max(max(f) for f in found) <= 1.2 * 2000


@pytest.mark.parametrize("nodes, strip", [(2000, 256), (40, 8)])
def test_short_templated_lines_equal_all_pairs(spark, monkeypatch, nodes, strip):
    monkeypatch.setattr(sketch_dedup, "NODES", nodes, raising=False)
    monkeypatch.setattr(sketch_dedup, "STRIP", strip, raising=False)
    head = [f"h{i}" for i in range(9)]
    rows = [(i, " ".join(head[:9 - i % 3] + words(i, 2 + i % 2, 60))) for i in range(150)]
    found = dict(multiset(sketch_dedup.near_duplicates(table(spark, rows), words=1), "doc_id", "component_id"))
    assert found == groups(rows, 1, 80)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (600, 100, 50))
    sets = [np.concatenate([both, a]), np.concatenate([both, b]), np.concatenate([both, a, b])]
    regs = sketch_dedup.registers(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()  # the union's registers
    j = sketch_dedup.likeness(np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]), np.array([700.0]), np.array([650.0]))[0]
    assert abs(j - 600 / 750) < 0.15


def test_registers_of_an_empty_set_and_of_one_element():
    regs = sketch_dedup.registers(np.array([5], np.uint64), np.array([0, 0, 1]))
    assert (regs[0] == 0).all() and (regs[1] > 0).all()


def test_components_of_paths_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(200, 240)] + [(50, 50)]
    found = dict(multiset(components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")), "node", "root"))
    assert found == {**{i: 0 for i in range(31)}, 100: 100, **{i: 100 for i in range(200, 240)}}


def windows_removed(rows, size):
    """Brute force: a window goes if a smaller id, or an earlier place of the same row, has it."""
    first, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - size + 1):
            key = tuple(w[p:p + size])
            first[key] = min(first.get(key, float("inf")), float("inf") if i is None else i)
    for i, t in rows:
        w, own, gone = (t or "").encode().split(), set(), set()
        for p in range(len(w) - size + 1):
            key = tuple(w[p:p + size])
            if key in own or first[key] < (float("inf") if i is None else i):
                gone.update(range(p, p + size))
            own.add(key)
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1500, 10**7])
@pytest.mark.parametrize("size", [20, 6, 2])
def test_repeated_windows(spark, corpus, size, block_bytes):
    found = substring_dedup.remove_repeats(table(spark, corpus), words=size, block_bytes=block_bytes)
    assert [(i, n, r, bytes(k)) for i, n, r, k in multiset(found, "doc_id", "n_words", "n_removed", "kept")] == windows_removed(corpus, size)


def test_removed_word_ranges(spark):
    text = " ".join(words(1, 30))
    found = substring_dedup.remove_repeats(table(spark, [(1, text), (2, "before " + text + " after")]))
    assert {r.doc_id: [tuple(x) for x in r.removed] for r in found.collect()} == {1: [], 2: [(1, 31)]}


def test_difference_covers_cover():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def bytes_removed(rows, size):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            first[b[p:p + size]] = min(first.get(b[p:p + size], float("inf")), float("inf") if i is None else i)
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - size + 1):
            if first[b[p:p + size]] < (float("inf") if i is None else i):
                gone.update(range(p, p + size))
        runs = sum(p - 1 not in gone for p in gone)
        out.append((i, len(b), len(gone), runs, bytes(x for p, x in enumerate(b) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1500, 10**7])
@pytest.mark.parametrize("size", [50, 12])
def test_shared_byte_strings(spark, corpus, size, block_bytes):
    found = suffix_dedup.remove_shared(table(spark, corpus), length=size, block_bytes=block_bytes).selectExpr("doc_id", "n_bytes", "n_removed", "size(removed) AS n_spans", "kept AS kept")
    assert [(*r[:4], bytes(r[4])) for r in multiset(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept")] == bytes_removed(corpus, size)


def test_levels_stay_few_and_find_all():
    rng = np.random.default_rng(3)
    batches = [np.unique(rng.integers(0, 3000, 100, dtype=np.uint64)) for _ in range(60)]
    levels, seen = suffix_dedup.Levels(), set()
    for batch in batches:
        found = levels.scan(batch)
        assert found.tolist() == [int(k) in seen for k in batch]
        levels.add(batch[~found])
        seen.update(batch.tolist())
        sizes = [len(t) for t in levels.tables]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 12


def test_empty_tables(spark):
    empty = table(spark, [])
    assert sketch_dedup.near_duplicates(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_shared(empty).count() == 0


def test_copies_of_an_id_with_other_text_are_no_copies(spark):
    text = " ".join(words(9, 30))
    rows = [(1, text), (2, text), (2, " ".join(words(10, 30)))]
    found = substring_dedup.remove_repeats(table(spark, rows))
    assert multiset(found, "doc_id", "n_removed") == [(1, 0), (2, 0), (2, 30)]


def test_blocks_keep_ids_together(spark):
    rows = [(i // 3, f"text {i}" * 20) for i in range(300)]
    laid, n = blocks.lay_out(table(spark, rows), "doc_id", "text", 2000)
    placed = laid.groupBy("id").agg({"block": "min"}).withColumnRenamed("min(block)", "low")
    assert n > 5
    assert laid.join(placed, "id").where("block <> low").count() == 0
    ordered = [r.low for r in placed.orderBy("id").collect()]
    assert ordered == sorted(ordered)


def test_kept_digest_of_nothing(spark):
    kept = substring_dedup.remove_repeats(table(spark, [(1, None)])).first().kept
    assert hashlib.sha256(kept).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_ids_may_be_any_longs(spark):
    text = " ".join(words(1, 60))
    rows = [(i, text) for i in (2**63 - 1, 2**63 - 2, -2**63, 2**53 + 1, 2**53)] + [(5, " ".join(words(2, 60)))]
    found = multiset(substring_dedup.remove_repeats(table(spark, rows), block_bytes=200), "doc_id", "n_removed")
    assert found == sorted([(i, 0 if i in (-2**63, 5) else 60) for i, _ in rows], key=repr)
