"""Single stages of the pipeline against the operators they use."""

import zlib

import corpus_pipeline
import numpy as np

from lectern.llm import quality

SF = "/root/testdata/sf0.001"


def test_quality_stage_removes_what_the_classifier_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    predicted = {r.doc_id: r.predicted for r in quality.op7_quality(spark, SF).collect()}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, SF).collect()}
    assert kept == {d for d, p in predicted.items() if p == 1}


def test_packing_stage_gives_the_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    rows = dict(corpus_pipeline.STAGES)["best-fit packing"](spark, docs, SF).collect()
    assert len({r.doc_id for r in rows}) == 20
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def test_edge_cases_pass_through_every_stage(spark, tmp_path):
    """Nulls in any column, empty, repeated and very long texts, empty tables and columns of clashing names."""
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew potions in silence"
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, None, None, 1), (1, None, "en", None), (2, "", "en", 3), (2, "", "en", 3), (3, "Plain words of a clean text that is like no other.", None, 4)]
    rows += [(4, "x " + item + " y", "en", 5), (None, "leaks " + item, "en", 6), (5, passage + " and one end", "en", 7), (6, "other head " + passage, "en", 8), (7, "long " * 300_000, "en", 9)]
    schema = "doc_id long, text string, __quality string, __ord int"
    df = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda found: sorted((tuple(r) for r in found.collect()), key=str)
    assert key(stages["quality classifier"](spark, df, str(tmp_path))) == sorted(rows, key=str)  # without labels none is rejected
    one = stages["SimHash near-dedup"](spark, df, str(tmp_path))
    assert one.columns == df.columns
    kept = key(one)
    assert sum(not r[1] for r in kept) == 1 and sum((r[1] or "").startswith("long") for r in kept) == 1
    three = key(stages["substring dedup"](spark, df, str(tmp_path)))
    assert [r[1] for r in three if r[0] == 6] == ["other head "] and [r[1] for r in three if r[0] == 5] == [rows[7][1]]
    assert sum(r[1] is None for r in three) == 2 and sum(r[1] == "" for r in three) == 2
    four = stages["benchmark decontamination"](spark, df, str(tmp_path))
    assert four.columns == df.columns and key(four) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
    five = stages["best-fit packing"](spark, df, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in five if r.piece == 0), key=str) == sorted((r[0] for r in rows), key=str)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, df.limit(0), str(tmp_path))
        assert none.count() == 0 and (name == "best-fit packing" or none.columns == df.columns)
