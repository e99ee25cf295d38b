"""The registered queries: against their SQL on the smallest data, or against plain Python where SQL cannot say it."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import pytest

from navloom.llm import fingerprints, language_id, textwords
from navloom.llm.oracles import ORACLES
from navloom.llm.queries import REGISTRY
from tests.llm.conftest import words

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("needs the driver's data")
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    found = REGISTRY[name](spark, DATA)
    columns = sorted(found.columns)
    result = con.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, result.select(", ".join(columns)).fetchall()))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rows = [(i, " ".join(words(i, 30 + 40 * i, 50 + i)) + (" Released under the MIT License." if i % 5 == 0 else ""), "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 - 34", "en"), (103, rows[4][1], "fr")]
    folder = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").write.parquet(f"{folder}/documents.parquet")
    return folder, {r[0]: r[1] for r in rows}


def test_packing_query(spark, small):
    folder, texts = small
    found = REGISTRY["op2_best_fit_packing"](spark, folder).collect()
    bins = {}
    for r in found:
        bins.setdefault(r.bin_id, []).append(r)
    for bin_id, rows in bins.items():
        if bin_id is None:
            assert {r.doc_id for r in rows} == {100, 101}
            continue
        rows.sort(key=lambda r: r.offset)
        ends = [r.offset + r.length for r in rows]
        assert [r.offset for r in rows] == [0, *ends[:-1]] and {r.capacity for r in rows} == {min(c for c in (256, 512, 1024, 2048) if c >= ends[-1])}
    for doc_id, text in texts.items():
        own = sorted((r.start, r.length) for r in found if r.doc_id == doc_id)
        assert [s for s, _ in own] == [2048 * i for i in range(len(own))] and sum(n for _, n in own) == len((text or "").split())


def test_license_query(spark, small):
    folder, texts = small
    found = {(r.doc_id, r.license, r.start, r.end) for r in REGISTRY["op4_license_scan"](spark, folder).collect()}
    line = "Released under the MIT License"
    assert found == {(i, "MIT", t.index(line), t.index(line) + len(line)) for i, t in texts.items() if t and line in t}


def test_fingerprint_query(spark, small):
    folder, texts = small
    found = {r.doc_id: r for r in REGISTRY["op5_fingerprints"](spark, folder).collect()}
    ids = sorted(texts, reverse=True)
    assert set(found) == set(ids)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        text, after = texts[i] or "", texts[j] or ""
        half = len(text) // 2
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
    assert found[103].fingerprint == found[4].fingerprint and found[100].near_next == 0 and found[101].near_next == 1


def mixed(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * factor) % 2**64
    return x ^ (x >> 33)


def hashed(data, seed):
    values, base = textwords._base(seed)[:2]
    return mixed(sum(int(values[c]) * pow(int(base), j, 2**64) for j, c in enumerate(data)) % 2**64)


def plain_fingerprint(text):
    """Closed syncmers k-mer by k-mer, the least key of each bin."""
    data, k, s = text.encode(), fingerprints.K, fingerprints.S
    inner = [hashed(data[p:p + s], 0) for p in range(len(data) - s + 1)]
    keys = [hashed(data[p:p + k], 1) for p in range(len(data) - k + 1) if min(inner[p:p + k - s + 1]) in (inner[p], inner[p + k - s])]
    if 0 < len(data) < k:
        keys = [int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")]
    bins = [min((x for x in keys if x % fingerprints.BINS == b), default=None) for b in range(fingerprints.BINS)]
    return [0 if x is None else mixed(x) % 65535 + 1 for x in bins]


def plain_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_fingerprints_equal_plain_syncmers(spark, small):
    folder, texts = small
    found = {r.doc_id: r for r in REGISTRY["op5_fingerprints"](spark, folder).collect()}
    ids = sorted(texts, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    for i in (103, 102, 101, 100, 5, 3, 2, 1, 0):
        text, after = texts[i] or "", texts[following[i]] or ""
        half = len(text) // 2
        own, edited, beside = (plain_fingerprint(t) for t in (text, text[:len(text) - half] + after[:half], after))
        assert found[i].fingerprint == "".join(f"{x:04x}" for x in own) and found[i].edited_fingerprint == "".join(f"{x:04x}" for x in edited)
        assert found[i].near_edited == pytest.approx(plain_likeness(own, edited)) and found[i].near_next == pytest.approx(plain_likeness(own, beside))


def plain_grams(text):
    data = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in text.encode())
    letter = [0x61 <= c <= 0x7A or c >= 0x80 for c in data]
    data = bytes(c if is_letter else 0x20 for c, is_letter in zip(data, letter))
    return [data[p:p + n] for n in (3, 4, 5) for p in range(len(data) - n + 1) if all(letter[p + 1:p + n - 1])]


def test_languages_equal_counted_sets(spark, small):
    """The filter against plain sets of each language's n-grams: no n-gram is lost, and shares differ by false positives only."""
    folder, texts = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts, lang = {}, {r.doc_id: r.lang for r in docs.collect()}
    for i, text in texts.items():
        if lang[i] and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang[i], Counter()).update(plain_grams(text or ""))
    common = {name: {g for g, n in c.items() if n >= max(2, language_id.COMMON * sum(c.values()))} for name, c in counts.items()}
    differ = 0
    for r in REGISTRY["op6_language_id"](spark, folder).collect():
        if r.lang_pred == "und":
            continue
        own = plain_grams(texts[r.doc_id])
        share = {name: sum(g in known for g in own) / len(own) for name, known in common.items()}
        assert r.score == pytest.approx(share[r.lang_pred], abs=0.01)
        best = max(share.values())
        assert share[r.lang_pred] >= best - 0.01
        differ += share[r.lang_pred] < best
    assert differ <= 1


def test_language_query(spark, small):
    folder, texts = small
    found = {r.doc_id: r for r in REGISTRY["op6_language_id"](spark, folder).collect()}
    assert set(found) == set(texts)
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (i in (100, 101, 102)) and r.lang_pred in ("en", "fr", "und")
    assert found[103].lang_pred == found[4].lang_pred  # equal texts, other labels
