"""The corpus pipeline, stage by stage, on a small table."""

import corpus_pipeline
from codelattice.llm import minhash_neardup
from codelattice.llm.common import connected_components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen[0] == seen[1] > seen[2] >= seen[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    starts = last.where("start = 0").groupBy("doc_id").count().collect()
    want = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert {r["doc_id"]: r["count"] for r in starts} == want


def test_second_stage_leaves_no_near_duplicates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert minhash_neardup.near_duplicates(left).where("not kept").count() == 0


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "123", "en", "a", 3), (3, "A real text.", None, None, 12), (3, "A real text.", None, None, 12), (4, "", "x", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs.count()
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
        assert none.count() == 0, name


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
