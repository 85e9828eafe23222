import os

import pytest
from test_near_copies import brute

from marginalia.llm import decontaminate, quality_rules, secrets, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_stage_takes_effect_and_loses_nothing_else(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF).persist()
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after)
        if name == "quality_rules":
            want = {r.doc_id for r in quality_rules.flagged(docs, labels).where("kept").collect()}
            assert set(after) == want and len(want) < len(before)
        elif name == "near_duplicates":
            want = set(brute([(r.doc_id, r.text) for r in before.values()]))
            assert set(after) == want and len(want) < len(before)
        elif name == "decontamination":
            bad = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - bad
        else:
            spans = {r.doc_id: r.spans for r in secrets.secrets(docs).collect()}
            assert set(after) == set(before)
            assert all((after[d].text != before[d].text) == bool(spans[d]) and after[d].n_chars == len(after[d].text) for d in before)
        docs = out
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == out.count() and set(got.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_representatives_with_null_ids_and_repeated_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, "x y z"), (5, None), (3, "")]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, "a b c d"), (None, "x y z"), (3, "")], key=str)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_stages_pass_other_columns_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, 1, "a"), (None, "", 2, "b"), (-5, None, 3, "c"), (-5, None, 3, "c")], "doc_id long, text string, rid long, _rid string")
    rows = docs.select("doc_id", "text", docs.doc_id.alias("rid"), docs.lang.alias("_rid")).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns, name
        if name != "quality_rules":  # which drops empty texts
            assert out.where("doc_id = -5").count() == (1 if name == "near_duplicates" else 2), name
