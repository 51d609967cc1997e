"""The stages of the pipeline, each on the output of the one before, against plain versions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqframe.functions.scratch import materialize
from seqframe.llm import near
from tests.llm import brute
from tests.llm.test_operators import near_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, "The and of it. " * 9), (90000, None), (90001, "12 !!"), (90002, "The thing and the other of it."), (90002, "The thing and the other of it.")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, 3) for i, t in odd], docs.schema))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF)))
    return out


def test_columns(steps):
    for table in steps[1:-1]:
        assert table.columns == steps[0].columns
    assert set(steps[-1].columns) > set(steps[0].columns) and steps[-1].count() == steps[-2].count()


def test_language_keeps_all_text(steps):
    gone = {r.doc_id for r in steps[0].collect()} - {r.doc_id for r in steps[1].collect()}
    assert gone == {90000, 90001}


def test_near_duplicates_keep_one_of_each_group(spark, steps):
    before = [(r.doc_id, r.text) for r in steps[2].collect()]
    sketch, n = near.frequency_sketch(steps[2], "text")
    groups = near_groups(before, sketch, n)
    want = sorted([i for i in {i for i, _ in before if i is not None} if groups.get(i, i) == i]) + [None] * sum(i is None for i, _ in before)
    assert sorted((r.doc_id for r in steps[3].collect()), key=lambda i: (i is None, i)) == want


def test_decontamination(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.contamination([(r.doc_id, r.text) for r in steps[3].collect()], items)
    want = {i for i, n, k, _ in hit if not (k > 0 and 20 * k >= n)}
    assert {r.doc_id for r in steps[4].collect()} == want


def test_no_documents(spark, steps):
    table = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, SF).count() == 0


def test_run(spark):
    done = corpus_pipeline.run(spark, SF)
    assert done.count() == done.select("mix_slot", "mix_row").distinct().count() > 0
    assert done.where(F.col("text").isNull()).count() == 0
