"""A training-data pipeline over ``documents``: five stages, each one operator of lectern.llm.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps with their columns; the last
returns the packed pieces. Each result is written as Parquet in the shared folder and read again; what a stage wrote on the
way is deleted when it is done. Rows with a null doc_id, null or empty texts, repeated rows and empty tables are treated as
the operators' docstrings say: null and empty texts are scored, are near-duplicates of each other, hold no passage and no item, and are
packed as an end mark. Columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common, decontaminate, packing, quality, simhash, substrings

#: Words of a shingle and similarity from which documents are near-duplicates too.
SIMILAR = (5, 0.8)
#: Documents below this probability of good quality go: the classifier's own decision.
KEEP = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = common.unused(docs, "quality")
    return quality.with_score(docs, net, name).where(F.col(name) >= KEEP).drop(name)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: by SimHash, and by 5-word shingles of similarity 0.8 or more."""
    return simhash.one_of_each(docs, similar=SIMILAR)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages of 50 words that a document with a smaller doc_id has too."""
    return substrings.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their ids, in sequences of 2048; other columns of the documents end here."""
    return packing.packed(docs, keep_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: SQL expresses neither the classifier nor the fingerprints; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = docs
        docs = common.written(spark, lambda stage=stage, done=done: stage(spark, done, sf_dir), f"stage{k}")
        if k:
            common.drop(done)
    return docs
