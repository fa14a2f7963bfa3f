"""The pipeline, stage by stage, and the registered queries with SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from linewarden.llm import common, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    base = common.table(spark, sf_dir, "documents").withColumn("extra", F.lit(1))
    words = " ".join(f"word{i} the of and" for i in range(60))
    odd = spark.createDataFrame([
        (10**6, None, "en", "s", 0, 1), (10**6 + 1, "12 34 !!", "en", "s", 8, 1), (10**6 + 2, words, "en", "s", 9, 1),
        (10**6 + 3, words + " end", None, None, None, None), (10**6 + 2, words, "en", "s", 9, 1),
        (None, "the only one without an id", "en", "s", 1, 1),
    ], DOCS)
    docs = base.unionByName(odd)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "line_dedup", "near_dedup", "packing"]
    first = common.written(stages["language"](spark, docs, sf_dir), "test")
    ids = {r[0] for r in first.select("doc_id").collect()}
    assert first.columns == docs.columns
    assert ids == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    second = common.written(stages["line_dedup"](spark, first, sf_dir), "test")
    assert second.columns == docs.columns and second.count() == first.count()
    assert second.where("n_chars != length(text)").count() == 0
    third = common.written(stages["near_dedup"](spark, second, sf_dir), "test")
    kept = [r[0] for r in third.select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= ids
    assert 10**6 + 2 in kept and 10**6 + 3 not in kept and None in kept
    last = stages["packing"](spark, third, sf_dir).collect()
    assert sorted(map(str, {r.doc_id for r in last})) == sorted(map(str, kept))


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "test")
        assert docs.count() == 0


def test_documents_stay_where_nothing_is_labelled(spark, sf_dir):
    rows = [(1, "some words", None, "s", 10, 1), (2, "12 !!", None, "s", 5, 1), (3, None, None, "s", 0, 1), (None, "é", None, "s", 1, 1)]
    stage = dict(corpus_pipeline.STAGES)["language"]
    for lang in (None, "en"):  # 2 is held out, so its label is not learnt
        docs = spark.createDataFrame([(*r[:2], lang if r[0] == 2 else None, *r[3:]) for r in rows], DOCS)
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns
        assert sorted(got.collect(), key=str) == sorted(docs.where("doc_id = 1 OR doc_id IS NULL").collect(), key=str)


def test_copies_that_lost_all_their_text_go(spark, sf_dir):
    texts = ["one long line " * 30, "a line of text\n\nanother line of it\n--"]
    rows = [(10 * k + d, text, "en", "s", len(text), 1) for k, text in enumerate(texts) for d in range(4)]
    stages, docs = dict(corpus_pipeline.STAGES), spark.createDataFrame([*rows, (30, "12 34 a", "en", "s", 7, 1)], DOCS)
    for name in ("language", "line_dedup", "near_dedup"):
        docs = common.written(stages[name](spark, docs, sf_dir), "test")
    assert sorted(r.doc_id for r in docs.collect()) == [0, 10, 30]
    assert {r.text for r in docs.collect()} == {*texts, "12 34 a"}


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    with duckdb.connect() as db:
        for source in ("documents", "embeddings", "conversations"):
            db.execute(f"CREATE VIEW {source} AS SELECT * FROM '{sf_dir}/{source}.parquet'")
        answer = db.execute(queries.sql()[name])
        columns, want = [c[0] for c in answer.description], answer.fetchall()
    got = queries.registered()[name](spark, sf_dir).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))


def test_rows_of_one_id_are_judged_by_their_own_texts(spark, sf_dir):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en", "s", 9, 1), (2, words + " end", "en", "s", 9, 1), (2, "another text of its own", "en", "s", 9, 1),
            (None, "no id", "en", "s", 9, 1), (None, "no id", "en", "s", 9, 1)]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = stage(spark, spark.createDataFrame(rows, DOCS), sf_dir).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, words), (2, "another text of its own"), (None, "no id")], key=str
    )


def test_documents_without_a_language_get_the_predicted_one(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    blank = docs.withColumn("lang", F.when(F.col("doc_id") % 10 != 0, F.col("lang")))
    got = dict(corpus_pipeline.STAGES)["language"](spark, blank, sf_dir).where("doc_id % 10 = 0").select("doc_id", "lang")
    both = got.join(docs.select("doc_id", F.col("lang").alias("known")), "doc_id").where("known IS NOT NULL").collect()
    assert len(both) > 10 and sum(r.lang == r.known for r in both) >= 0.9 * len(both)
