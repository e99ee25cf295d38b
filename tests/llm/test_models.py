import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from navloom.llm import fingerprints, language_id, packing, ranges, warc
from tests.llm.conftest import multiset, table, words

LETTERS = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "éèàüößñqrst"}


def tongue(lang, seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(LETTERS[lang]), int(rng.integers(2, 8)))) for _ in range(n))


def test_languages_are_told_apart(spark):
    rows = [(i, tongue(lang, i), lang) for i, lang in enumerate(sorted(LETTERS) * 60)] + [(1000, None, "aa"), (1001, "", "bb"), (1002, "text", None)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"))
    assert model.languages == ("aa", "bb", "cc")
    held = [(2000 + i, tongue(lang, 9000 + i), lang) for i, lang in enumerate(sorted(LETTERS) * 20)]
    found = language_id.identify(spark.createDataFrame(held, "doc_id BIGINT, text STRING, lang STRING"), model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 58
    assert all(0 <= r.score <= 1 for r in found)


def test_undetermined_texts(spark):
    model = language_id.fit(spark.createDataFrame([(1, tongue("aa", 1), "aa"), (2, tongue("bb", 2), "bb")], "doc_id BIGINT, text STRING, lang STRING"))
    rows = [(1, None), (2, ""), (3, "123 !? — ٣"), (4, "é"), (5, "a"), (None, "abc")]
    found = {r.doc_id: r.lang_pred for r in language_id.identify(table(spark, rows), model).collect()}
    assert {i for i, lang in found.items() if lang == "und"} == {1, 2, 3}
    nothing = language_id.fit(table(spark, [], ", lang STRING").where("false").select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in language_id.identify(table(spark, rows), nothing).collect()} == {"und"}
    assert language_id.identify(table(spark, []), model).count() == 0
    with pytest.raises(ValueError):
        language_id.identify(table(spark, []).withColumn("score", F.lit(1)), model, keep=("doc_id", "score"))


def test_more_than_64_languages(spark):
    rows = [(i, f"{chr(0x4E00 + 7 * i) * 3} {chr(0x4E00 + 7 * i)}word", f"l{i:03d}") for i in range(70)] * 2
    model = language_id.fit(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"))
    assert model.masks.shape[1] == 2
    found = language_id.identify(spark.createDataFrame([(i, t) for i, t, _ in rows[:70]], "doc_id BIGINT, text STRING"), model).collect()
    assert all(r.lang_pred == f"l{r.doc_id:03d}" for r in found)
    with pytest.raises(ValueError, match="more than 69"):
        language_id.fit(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"), max_languages=69)


def slow_pack(lengths, capacities):
    """Best fit with a scan over all open bins."""
    bins, out, rest = [], [], sum(lengths)
    for n in lengths:
        rest -= n
        open_ = [(b[0] - b[1], -len(b), k) for k, b in enumerate(bins) if b[0] - b[1] >= n]
        if open_:
            room = min(open_)[0]
            k = max((bins[k][2], k) for r, _, k in open_ if r == room)[1]
        else:
            c = min((c for c in capacities if c >= n), key=lambda c: (packing.cost(c) / (n + min(c - n, rest)), c))
            bins.append([c, 0, 0])
            k = len(bins) - 1
        out.append(k)
        bins[k][1] += n
        bins[k][2] = len(out)  # the latest to get its room comes first
    return out


@pytest.mark.parametrize("seed", range(5))
def test_packing_equals_a_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted((int(x) for x in rng.integers(1, 64, 200)), reverse=True)
    bins, offsets, final = packing.pack(lengths, (16, 32, 64))
    assert bins == slow_pack(lengths, (16, 32, 64))
    for b, capacity in enumerate(final):
        used = sum(n for n, k in zip(lengths, bins) if k == b)
        assert capacity == min(c for c in (16, 32, 64) if c >= used)


def test_every_token_lies_in_one_place(spark):
    rng = np.random.default_rng(1)
    counts = [(i, int(n)) for i, n in enumerate(rng.integers(0, 300, 500))] + [(1000, 100_000), (1001, None), (1002, 0), (None, 70), (5, 64), (5, 64)]
    found = packing.best_fit(spark.createDataFrame([(*c, 1) for c in counts], "doc_id BIGINT, n_tokens INT, piece INT"), capacities=(32, 64, 128), shard_pieces=100).collect()
    bins = {}
    for r in found:
        if r.length:
            bins.setdefault(r.bin_id, []).append(r)
        else:
            assert r.bin_id is None and r.capacity is None
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert {r.capacity for r in rows} == {min(c for c in (32, 64, 128) if c >= at)}
    pieces = sorted(((r.doc_id, r.start, r.length) for r in found), key=repr)
    assert pieces == sorted(((i, s, min(128, (n or 0) - s)) for i, n in counts for s in range(0, max(n or 0, 1), 128)), key=repr)
    filled = sum(r.length for r in found) / sum(rows[0].capacity for rows in bins.values())
    assert filled > 0.9


def test_packing_refuses_negative_counts_and_takes_nothing(spark):
    schema = "doc_id BIGINT, n_tokens BIGINT"
    with pytest.raises(Exception, match="negative"):
        packing.best_fit(spark.createDataFrame([(1, -1)], schema)).collect()
    assert packing.best_fit(spark.createDataFrame([], schema)).count() == 0


def test_word_counts(spark, corpus):
    found = multiset(packing.word_counts(table(spark, corpus)), "doc_id", "n_tokens")
    assert found == sorted(((i, len((t or "").encode().split())) for i, t in corpus), key=repr)


@pytest.mark.parametrize("range_bytes", [500, 10**7])
def test_fingerprints_beside_edits(spark, corpus, range_bytes):
    rows = [r for r in corpus if r[0] != 7] + [corpus[7]]
    found = fingerprints.fingerprints_beside_edits(table(spark, rows), range_bytes=range_bytes).collect()
    with_id = sorted((r for r in rows if r[0] is not None), reverse=True)
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    assert len(found) == len(rows)
    for (i, text), (_, after) in zip(with_id, with_id[1:]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if text == after:
            assert got[i].near_next == 1
        if len(text) > 300 and len(after) > len(text) // 2 and text != after and i != 401:  # 401 is one word over and over
            assert 0.1 < got[i].near_edited < 1
    prints = {}
    for i, text in with_id:
        assert prints.setdefault(text or "", got[i].fingerprint) == got[i].fingerprint
    near = {r.doc_id: r.near_next for r in found}
    assert near[207] > 0.6 and near[19] < 0.2


def test_one_document_is_its_own_next_and_no_document(spark):
    (r,) = fingerprints.fingerprints_beside_edits(table(spark, [(1, "abcd" * 30)])).collect()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(("abcd" * 30).encode()).hexdigest()
    assert fingerprints.fingerprints_beside_edits(table(spark, [])).count() == 0


def test_syncmers_do_not_depend_on_what_stands_around():
    rng = np.random.default_rng(0)
    passage = rng.integers(97, 123, 500).astype(np.uint8)
    sets = []
    for n in (0, 13, 400):
        data = np.concatenate([rng.integers(97, 123, n).astype(np.uint8), passage, rng.integers(97, 123, 50).astype(np.uint8)])
        _, starts, keys = fingerprints.syncmers(data, np.array([0, len(data)]))
        sets.append({(int(s) - n, int(k)) for s, k in zip(starts, keys) if n <= s <= n + 500 - fingerprints.K})
    assert sets[0] == sets[1] == sets[2] and len(sets[0]) > 50


def test_anchors_match_at_one_shift(spark):
    passage = " ".join(words(5, 60))
    found = fingerprints.matches(table(spark, [(1, passage)]), table(spark, [(2, "xx " + passage), (3, " ".join(words(6, 60)))])).collect()
    assert [(r.doc_id, r.other_id, r["shift"]) for r in found] == [(1, 2, 3)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id BIGINT, url STRING, html STRING, digest STRING")


PAGES = [(1, "http://a/x", "<p>" + "long page " * 50), (2, "http://a/y", "<p>" + "long page " * 50), (9, None, "<p>" + "long page " * 50), (3, "http://b/é z", "short"),
         (4, "http://b", "short"), (5, "http://c", None), (6, "http://c", ""), (7, "http://d", "é" * 60), (8, "http://d", "é" * 60), (None, "http://e", "<p>" + "long page " * 50),
         (3, "http://b/2", "other text " * 20), (10, "http://f", "x" * 200_000)]


def expected_records(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = i is not None and len(data) >= 100 and first[html or ""] < i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes,roll_bytes", [(300, 1), (10**7, 10**7)])
def test_archives_round_trip(spark, tmp_path, shard_bytes, roll_bytes):
    manifests = []
    for run in ("one", "two"):
        root = f"file://{tmp_path}/{run}"
        manifests.append(sorted(tuple(r) for r in warc.write_archives(pages(spark, PAGES), root, shard_bytes=shard_bytes, roll_bytes=roll_bytes).collect()))
        found = warc.read_archives(spark, root, with_payload=True)
        assert multiset(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected_records(PAGES)
        responses = {(r.page_id, bytes(r.payload)) for r in found.where("record_type = 'response'").collect()}
        assert responses >= {(10, b"x" * 200_000), (5, b""), (3, b"short")}
    assert manifests[0] == manifests[1]  # the same names, sizes and digests
    assert len(manifests[0]) == (1 if roll_bytes > 1 else len(PAGES))
    assert not list((tmp_path / "one" / "_temporary").iterdir())


def test_archives_of_no_pages(spark, tmp_path):
    assert warc.write_archives(pages(spark, []), f"{tmp_path}/none").count() == 0
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_even_ranges_split_crowded_steps(spark):
    ids = [(i, 1) for i in range(1000)] + [(10**15 + i, 1) for i in range(50)]
    bounds = ranges.even_ranges(spark.createDataFrame(ids, "id BIGINT, n INT"), "id", "n", 100)
    edges = [*bounds, 2**62]
    held = [sum(a <= i < b for i, _ in ids) for a, b in zip(edges, edges[1:])]
    assert bounds[0] == 0 and sum(held) == 1050 and max(held) <= 300


def test_even_ranges_over_all_longs(spark):
    ids = [(-2**63, 5), (-1, 5), (0, 5), (2**63 - 1, 5)]
    bounds = ranges.even_ranges(spark.createDataFrame(ids, "id BIGINT, n INT"), "id", "n", 4)
    assert [sum(b <= i for b in bounds) for i, _ in ids] == [1, 2, 3, 4]
    assert ranges.even_ranges(spark.createDataFrame([(None, 5)], "id BIGINT, n INT"), "id", "n", 4) == []


def test_token_counts_of_a_given_vocabulary(spark, tmp_path):
    vocabulary = [bytes([i]) for i in range(256)] + [b"th", b"the", b" t", b" th", b" the"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(token) + b" %d" % rank for rank, token in enumerate(vocabulary)) + b"\n")
    rows = [(1, "the the"), (2, "xyz"), (3, None), (4, ""), (5, "é")]
    assert multiset(packing.token_counts(table(spark, rows), str(path)), "doc_id", "n_tokens") == [(1, 2), (2, 3), (3, 0), (4, 0), (5, 2)]
