"""The pipeline, stage by stage, against plain computations on its own stages' input."""

import corpus_pipeline
import pytest
from test_packing import placed_well
from wardline.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.schema == stages[0].schema


def test_kept_rows_are_whole(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.exceptAll(before).count() == 0


def test_quality_stage_is_the_query(spark, stages):
    from wardline.llm import quality

    kept = {r.doc_id for r in quality.quality_rules(stages[0]).where("kept").collect()}
    assert kept == {r.doc_id for r in stages[1].collect()}


def test_toxic_documents_go(spark, stages):
    from wardline.llm import toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in toxicity.toxicity(stages[1], labels).where("predicted = 0").collect()}
    assert kept == {r.doc_id for r in stages[2].collect()}


def test_one_of_each_group_stays(stages):
    rows = sorted((r.doc_id, fingerprint(r.text)) for r in stages[2].collect())
    root = {doc: doc for doc, _ in rows}

    def least(doc):
        while root[doc] != doc:
            doc = root[doc]
        return doc

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 3:
                one, two = sorted((least(a), least(b)))
                root[two] = one
    assert {r.doc_id for r in stages[3].collect()} == {doc for doc in root if root[doc] == doc}


def test_every_kept_document_is_packed(stages):
    rows = stages[4].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[3].collect()}
    placed_well(rows, 2048)


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (None, text + " x", None, None), (2, None, "en", "a"), (3, "", None, "b")]
    docs = spark.createDataFrame([(*r, 1, "c", 7) for r in rows], "doc_id long, text string, lang string, source string, row int, kept string, uid int")
    one = corpus_pipeline.quality_rules(spark, docs, SF)
    two = corpus_pipeline.toxic_documents(spark, one, SF)
    three = corpus_pipeline.near_duplicates(spark, two, SF)
    assert one.count() == two.count() == 3 and three.columns == docs.columns
    assert {r.doc_id for r in three.collect()} <= {1, None}
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0, name
        empty = docs.limit(0)
