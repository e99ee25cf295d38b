from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import words
from tests.llm.test_scans import hits


def make(spark, folder):
    benchmark = [(1, " ".join(words(900, 20)))]
    rows = [(i, " ".join(words(i, 60)), "en", f"s{i % 3}", None) for i in range(12)]
    rows += [(20, rows[0][1], "en", "s1", None), (21, rows[1][1] + " more", "en", "s1", None), (22, "12 34 !!", "en", "s2", None), (23, None, None, None, None), (24, "", "en", "s1", None),
             (25, " ".join(words(33, 30)) + " " + benchmark[0][1], "en", "s1", None), (26, " ".join(words(44, 50)) + " password=abcdefgh1234 tail", "en", "s1", None),
             (None, " ".join(words(55, 50)), "en", "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return rows, benchmark


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    rows, benchmark = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append(sorted((r.doc_id for r in docs.select("doc_id").distinct().collect()), key=repr))
        if k < 4:
            assert docs.columns == columns
    every = {r[0] for r in rows}
    assert set(ids[0]) == every - {22, 23, 24}
    assert set(ids[1]) == set(ids[0]) - {20, 21}
    assert {r[0] for r in hits([(r[0], r[1]) for r in rows], benchmark, 10) if r[2]} == {25}
    assert set(ids[2]) == set(ids[1]) - {25}
    assert ids[3] == ids[2] == ids[4]
    kept = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    for r in rows:
        if r[0] in kept and r[0] != 26:
            assert kept[r[0]].text == r[1]
    assert kept[26].text == rows[-2][1].replace("password=abcdefgh1234", "[SECRET]") and kept[26].n_chars == len(kept[26].text)


def test_run_chains_the_stages(spark, tmp_path):
    make(spark, str(tmp_path))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {*range(12), 26, None}
    assert all(r.bin_id is not None and r.length > 0 for r in found)


def test_empty_documents(spark, tmp_path):
    make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_columns_of_any_name_come_through(spark, tmp_path):
    make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clashing = ["text_hash", "spans", "row", "score", "lang_pred", "kept", "node", "_0", "id", "bucket", "n_tokens"]
    for c in clashing:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
    rows = docs.collect()
    assert len(rows) == 14
    for r in rows:
        assert all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for c in clashing)


def test_rows_that_share_an_id_keep_their_texts(spark, tmp_path):
    one, two = " ".join(words(1, 60)), " ".join(words(2, 60))
    rows = [(1, one), (1, two), (1, two + " more"), (2, one), (3, " ".join(words(3, 60))), (3, " ".join(words(4, 60))), (3, None), (None, one), (None, one)]
    docs = spark.createDataFrame(rows + rows[4:5], "doc_id BIGINT, text STRING")
    found = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()]
    near = [r for r in found if r in rows[1:3]]
    assert len(near) == 1
    assert sorted(found, key=repr) == sorted([rows[0], *near, *rows[4:]], key=repr)


def test_without_labels_every_text_with_a_letter_stays(spark, tmp_path):
    rows = [(1, "some plain words of a document", None), (2, "ещё один текст на другом языке", None), (3, "文字", None), (4, "12 34 !!", None), (5, "", None), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    assert sorted(tuple(r) for r in corpus_pipeline.in_known_language(spark, docs, str(tmp_path)).collect()) == rows[:3]
