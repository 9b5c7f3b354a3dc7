"""The pipeline's stages on a small table: each one's decisions, checked against the operators' definitions."""

import pytest

import corpus_pipeline
from hourgrid.llm import decontaminate, simhash
from hourgrid.llm.common import landed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = landed(stage(spark, docs, SF))
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_shrinking(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == list(corpus_pipeline.COLUMNS) and ids(after) <= ids(before) and after.count() == len(ids(after))
    assert ids(stages[-1]) == ids(stages[-2])


def test_rejects_are_junk(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = ids(stages[0]) - ids(stages[1])
    assert sum(labels.get(i) == 1 for i in gone) <= 1
    assert sum(labels.get(i) == 0 for i in ids(stages[1])) <= 2


def test_one_of_each_class_stays(stages):
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(stages[1]).collect()}
    assert ids(stages[2]) == set(classes.values())


def test_no_document_is_contaminated(spark, stages):
    found = decontaminate.find_contamination(stages[4], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert found.where("size(spans) > 0").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in stages[-1].collect())


def test_stages_on_edges(spark):
    long = " ".join(f"word{k % 997}" for k in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n", None, "s", 3), (None, "no id here", "de", None, 5), (None, "no id here", "de", None, 5), (4, "the same id", "en", "s", None), (4, "but not the same text", "en", "s", None), (5, long, "en", "s", len(long)), (6, "ß 日本 👍", "en", "s", 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 as id", "'x' as raw", "0.5 as score", "text as component_id", "2 as n_words", "3L as t", "4 as spans")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        out = got.collect()
        if name != "packing":
            assert got.columns == list(corpus_pipeline.COLUMNS) and all(r.n_chars == len(r.text or "") or name in ("quality", "near_duplicates") for r in out)
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == got.columns and empty.count() == 0
        if name == "near_duplicates":  # texts of under four words have fingerprints of their own; no words: one class
            assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(0, "no id here"), (1, ""), (4, "the same id"), (4, "but not the same text"), (5, long), (6, "ß 日本 👍")])
        if name in ("passages", "benchmark"):
            assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted((i or 0, t or "") for i, t, *_ in rows)
        if name == "packing":
            assert {r.doc_id for r in out} == {i for i, *_ in rows} and all(r.start + r.length <= r.doc_tokens for r in out)


def test_intermediate_tables_go(spark):
    import os

    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    corpus_pipeline.run(spark, SF).count()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(base)) - before}
    assert "benchmark" in left and not left & {"quality", "near_duplicates"} and "passages" in left
