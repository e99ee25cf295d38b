import hashlib

import pytest
from pyspark.sql import functions as F

from navloom.llm import merkle_manifest as merkle
from tests.llm.conftest import ODD, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climbed(nodes):
    """The root over digests in order, and each one's steps, by following every node up."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            sibling = nodes[other] if other < len(nodes) else ""
            paths[i].append((sibling, "") if place % 2 else ("", sibling))
            at[i] = place // 2
        nodes = [sha("".join(nodes[j:j + 2])) for j in range(0, len(nodes), 2)]
    return nodes[0], paths


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def expected(rows, columns, lang):
    groups = {}
    for row in rows:
        groups.setdefault(row[lang], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of([row[c] for c in columns])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = [climbed([leaf for *_, leaf in sorted(groups[g])]) for g in names]
    root, above = climbed([top for top, _ in tops])
    out = []
    for (top, paths), up, g in zip(tops, above, names):
        for (known, doc_id, leaf), path in zip(sorted(groups[g]), paths):
            out.append((doc_id if known else None, leaf, top, root, tuple(path + up)))
    return sorted(out, key=repr)


def manifested(df, **more):
    found = merkle.manifest(df, columns=("doc_id", "lang", "text"), **more).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(tuple(s) for s in r.path)) for r in found), key=repr)


@pytest.mark.parametrize("bits", [1, 2, 3, 10])
def test_blocks_of_any_size_give_the_same_tree(spark, bits):
    rows = [(i, " ".join(words(i, 5)), lang) for lang, n in (("b", 37), ("ä", 16), ("a", 1), (None, 2), ("", 3)) for i in range(1000 + 3 * n, 1000 + 4 * n)]
    rows += [(i, t, "b") for i, t in ODD] + [rows[0], rows[0]]
    df = spark.createDataFrame([(i, t, lang, "x", "y", "z") for i, t, lang in rows], "doc_id BIGINT, text STRING, lang STRING, g STRING, data STRING, leaf STRING")
    assert manifested(df, bits=bits) == expected([{"doc_id": i, "text": t, "lang": lang} for i, t, lang in rows], ("doc_id", "lang", "text"), "lang")


def test_a_manifest_finds_what_was_changed(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "fr") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    other = merkle.leaf_digest([F.col("doc_id"), F.col("lang"), F.concat("text", F.when(F.col("doc_id") == 17, F.lit("!")).otherwise(F.lit("")))])
    found = merkle.manifest(df, columns=("doc_id", "lang", "text"), carry={"seen": other}, bits=3)
    bad = found.where(merkle.folded(F.col("seen"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in bad.collect()] == [17]
    assert found.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_empty_and_single_tables(spark):
    df = spark.createDataFrame([(1, "one", "en")], "doc_id BIGINT, text STRING, lang STRING")
    assert manifested(df.where("doc_id > 1")) == []
    leaf = leaf_of([1, "en", "one"])
    assert manifested(df) == [(1, leaf, leaf, leaf, ())]
