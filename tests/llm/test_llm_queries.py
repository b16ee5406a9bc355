"""Registered queries of the package against their SQL, and the pipeline's stages."""

import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from hazecast.llm.queries import QUERIES
from hazecast.llm.sql import ORACLES
from llm_helpers import documents, hard_rows
from workload.check import compare, database

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), database(FOLDER), ORACLES[name]).startswith("ok")


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, []
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "near-duplicates"):
            assert docs.exceptAll(before).count() == 0
        if name == "repeats":
            assert seen[-1] == seen[-2]
            assert docs.join(before, "doc_id").filter(docs.text.isNull() != before.text.isNull()).count() == 0
    assert all(seen)


def run_stages(spark, docs, folder, out):
    """All stages over ``docs``, each written and read again; what each returned."""
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        seen.append(docs)
    return seen


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    rows = hard_rows() + [(100 + i, f"vile slur{i % 7} words number {i}", "en", "a") for i in range(40)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(100 + i, 1, int(i % 2 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/tables/labels.parquet")
    seen = run_stages(spark, docs, f"{tmp_path}/tables", f"{tmp_path}/out")
    assert all(s.columns == docs.columns for s in seen[:4])
    kept = seen[0].collect()
    assert {(r.doc_id, r.text) for r in kept} <= {r[:2] for r in rows}
    ones = {r.doc_id: r.text for r in seen[1].collect()}
    # the least id of each group of equal texts; blank texts are one group
    assert ones[1] == "One two three four." and 6 not in ones and len(ones) == seen[1].count()
    assert seen[2].count() == seen[1].count() and seen[3].count() > 0
    assert {r.doc_id for r in seen[4].select("doc_id").distinct().collect()} <= set(ones)


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/tables/labels.parquet")
    seen = run_stages(spark, documents(spark, []), f"{tmp_path}/tables", f"{tmp_path}/out")
    assert [s.count() for s in seen] == [0] * 5


def test_a_stage_deletes_what_earlier_ones_left(spark, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    stages["near-duplicates"](spark, docs, FOLDER).write.parquet(f"{tmp_path}/one")
    left = list(corpus_pipeline._written)
    assert any(os.path.isdir(p) for p in left) and all(p.startswith(shared) for p in left)
    one = spark.read.parquet(f"{tmp_path}/one")
    two = stages["repeats"](spark, one, FOLDER)
    assert not any(os.path.isdir(p) for p in left)
    # a stage whose input still reads such tables leaves them
    three = stages["mixing"](spark, two, FOLDER)
    assert three.count() > 0
