import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from navloom.llm import toxicity
from tests.llm.conftest import ODD, table, words

BAD = [f"slur{i}" for i in range(8)]


def random_index(rng, n, n_terms, block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    dense = rng.random((n, n_terms)) * (rng.random((n, n_terms)) < 0.2)
    dense[rng.integers(n, size=n // 3)] = dense[0]  # ties
    dense = dense[dense.sum(1) > 0]
    dense /= np.sqrt((dense**2).sum(1))[:, None]
    vectors = [(np.flatnonzero(v), v[v > 0]) for v in dense]
    ids = rng.permutation(len(dense)).astype(np.int64)
    return dense, ids, toxicity.build_index(ids, np.zeros(len(dense)), np.ones(len(dense)), vectors, n_terms)


@pytest.mark.parametrize("block", [1, 4, 64])
def test_neighbours_equal_a_full_scan(monkeypatch, block):
    rng = np.random.default_rng(block)
    for n, n_terms, k in ((1, 3, 5), (40, 6, 5), (300, 12, 7), (300, 40, 25)):
        dense, ids, index = random_index(rng, n, n_terms, block, monkeypatch)
        for _ in range(30):
            query = rng.random(n_terms) * (rng.random(n_terms) < 0.3)
            terms = np.flatnonzero(query)
            if not len(terms):
                assert not len(index.nearest(terms, query[terms], k)[0])
                continue
            query /= np.sqrt((query**2).sum())
            sims = dense @ query
            some = sims[sims > 0]
            least = np.sort(some)[-k] if len(some) >= k else 0
            expected = {(int(ids[i]), round(float(sims[i]), 9)) for i in np.flatnonzero((sims > 0) & (sims >= least - 1e-12))}
            near, found = index.nearest(terms, query[terms], k)
            assert {(int(index.ids[e]), round(float(s), 9)) for e, s in zip(near, found)} == expected


def test_few_blocks_are_scored(monkeypatch):
    """A query that one block answers does not read the postings of the others."""
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    vectors = [(np.array([t]), np.ones(1)) if i < 40 else (np.array([t, 50 + t]), np.array([0.6, 0.8])) for t in range(5) for i in range(80)]
    index = toxicity.build_index(np.arange(400), np.zeros(400), np.ones(400), vectors, 60)
    read = []

    class Seen(np.ndarray):
        def __getitem__(self, key):
            read.append(np.size(key))
            return np.asarray(self)[key]

    object.__setattr__(index, "weight", index.weight.view(Seen))
    near, sims = index.nearest(np.array([2]), np.ones(1), 10)
    assert len(near) == 40 and (sims == 1).all() and sum(read) < 80


def test_words_are_parted_and_lowered():
    def count(text):
        return len(toxicity.terms_of(pa.array([text]))[0])

    def same(a, b):
        return sorted(toxicity.terms_of(pa.array([a]))[0]) == sorted(toxicity.terms_of(pa.array([b]))[0])

    assert count(None) == count("") == count(" .,%$ \u2014\u201c\u201d\u00ab\u00a0\u00bb\u3000") == 0
    assert same("“Fool”—fool… (FOOL) fool%%%", "fool fool fool fool") and same("naïve «été»", "naïve été")


def corpus(n, seed):
    """Every fourth document has one to three of its bad words; labels of a twentieth are wrong."""
    rng = np.random.default_rng(seed)
    rows, labels = [], {}
    for i in range(n):
        text = words(seed * 10_000 + i, int(rng.integers(20, 120)), 900)
        toxic = int(i % 4 == 0)
        for _ in range(int(rng.integers(1, 4)) if toxic else 0):
            text.insert(int(rng.integers(len(text))), rng.choice(BAD).upper() + rng.choice([",", ".", "!", ""]))
        rows.append((i, " ".join(text)))
        labels[i] = 1 - toxic if rng.random() < 0.05 else toxic
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus(1200, 1)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    marks = spark.createDataFrame([(i, t) for i, t in labels.items() if i % 3], "doc_id BIGINT, toxic INT")
    model = toxicity.fit(docs.where("doc_id % 3 <> 0"), marks, corpus=docs)
    assert 8 <= len(model.vocabulary) <= 12
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    wrong = [i for i in range(0, 1200, 3) if (found[i].score >= 0.7) != (i % 4 == 0)]
    assert len(wrong) <= 8
    assert all(0 <= r.score <= 1 and len(r.evidence) <= 3 for r in found.values())
    near = next(r for i, r in found.items() if i % 12 == 0)
    assert [e.similarity for e in near.evidence] == sorted((e.similarity for e in near.evidence), reverse=True) and all(e.id % 3 for e in near.evidence)


def test_copies_of_one_passage_are_no_evidence(spark):
    """A clean passage that was copied into 40 documents of label 1 does not become a sign of it."""
    rows, labels = corpus(600, 2)
    passage = " ".join(f"only{i}" for i in range(50))
    rows += [(5000 + i, passage + f" tail{i}") for i in range(40)]
    labels |= {5000 + i: 1 for i in range(40)}
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id BIGINT, toxic INT"))
    found = toxicity.score(spark.createDataFrame([(1, passage), (2, f"well {BAD[0]} {BAD[1]}")], "doc_id BIGINT, text STRING"), model).collect()
    assert {r.doc_id: r.score >= 0.7 for r in found} == {1: False, 2: True}


def test_odd_rows_and_names(spark):
    rows, labels = corpus(400, 3)
    rows += ODD + [rows[0], rows[0]]
    marks = [(i, t) for i, t in labels.items()] + [(0, 0), (0, 1), (None, 1), (1, None), (2, 7), (901, 1), (99_999, 1)]
    model = toxicity.fit(table(spark, rows), spark.createDataFrame(marks, "doc_id BIGINT, toxic INT"))
    found = toxicity.score(table(spark, rows), model, keep=("doc_id", "kept")).collect()
    assert len(found) == len(rows)
    assert {r.score for r in found if r.doc_id in (901, 902, 903, 906)} == {model.alone}
    assert len({r.score for r in found if r.doc_id == 0}) == 1
    assert toxicity.score(table(spark, []), model).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(table(spark, []).withColumn("score", F.lit(1)), model, keep=("doc_id", "score"))


def test_without_labels(spark):
    docs = table(spark, [(1, "a b c"), (2, None)])
    none = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.fit(table(spark, []), spark.createDataFrame([(1, 1)], "doc_id BIGINT, toxic INT")).prior == 0
    one = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id BIGINT, toxic INT"))
    assert {r.score for r in toxicity.score(docs, one).collect()} == {1.0}
