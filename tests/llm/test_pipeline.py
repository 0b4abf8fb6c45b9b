"""The pipeline against brute force, stage by stage, on the smallest tables."""

import hashlib

import corpus_pipeline
import pyarrow as pa
from tests.llm.test_decontaminate import reduce_plain, semiglobal
from tests.llm.test_simhash import brute as simhash_brute
from tests.llm.test_substrings import brute as substring_brute

from lectern.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    net = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    (_, f1), (_, f2), (_, f3), (_, f4), (_, f5) = corpus_pipeline.STAGES
    one = f1(spark, docs, SF)
    score = dict(zip(rows, net.score([(r.text or "").encode() for r in rows.values()])))
    kept = {d: rows[d].text for d in rows if score[d] >= corpus_pipeline.KEEP}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(kept)

    one = spark.createDataFrame([rows[d] for d in kept], docs.schema)
    two = f2(spark, one, SF)
    first = {a for a, _, c in simhash_brute(list(kept.items()), (5, 0.8)) if a == c}
    kept = {d: t for d, t in kept.items() if d in first}
    assert two.columns == docs.columns and {r.doc_id: r.text for r in two.collect()} == kept

    two = spark.createDataFrame([rows[d] for d in kept], docs.schema)
    three = f3(spark, two, SF)
    want = {d: s for d, n, gone, s in substring_brute(list(kept.items()), 50) if not (n and n == gone)}
    got = {r.doc_id: r.text for r in three.collect()}
    assert three.columns == docs.columns and {d: hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for d, t in got.items()} == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    budget = decontaminate.Items(items).budget.tolist()
    three = spark.createDataFrame([{**rows[d].asDict(), "text": t} for d, t in got.items()], docs.schema)
    four = {r.doc_id for r in f4(spark, three, SF).collect()}
    clean = set()
    for d, t in got.items():
        text = reduce_plain(t)
        if not any(reduce_plain(s) in text for _, s in items):
            clean.add(d)
    assert four <= clean
    named = {(r.doc_id, r.item_id) for r in decontaminate.matches(three, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert clean - four <= {d for d, _ in named}
    for d, i in named:  # what else goes is within the edit budget
        if d in clean:
            assert semiglobal(reduce_plain(dict(items)[i]), reduce_plain(got[d])) <= dict(zip((x for x, _ in items), budget))[i]
    last = f5(spark, spark.createDataFrame([{**rows[d].asDict(), "text": got[d]} for d in four], docs.schema), SF).collect()
    assert {r.doc_id for r in last} == four
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == four


def test_word_caches_of_one_operator_leave_the_workers_of_the_next(spark):
    """A worker has one coder however many tasks it served, and drops it and the words of passages for the next operator."""
    from lectern.llm import common, packing, substrings, toxicity

    def held(batches):
        from lectern.llm import common, packing, substrings, toxicity

        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"rows": [n], "coders": [len(packing._coders)], "known": [len(common._caches)], "words": [len(substrings._HASHES) + len(toxicity._TERMS)]})

    docs = spark.range(80).selectExpr("id as doc_id", "concat('some words and number ', id) as text").repartition(16)
    look = lambda: spark.range(8, numPartitions=8).mapInArrow(held, "rows long, coders long, known long, words long").collect()
    packing.token_pieces(docs).count()
    found = look()
    assert max(r.coders for r in found) == 1 and max(r.known for r in found) <= 3  # one of each operator at most, not one of each task
    substrings._sketches(docs, 2).count()
    assert all(not (r.coders and r.words) for r in look()) and max(r.words for r in look())
    assert substrings._hashes()[b"word"] and list(common.trimmed(iter, substrings._hashes)([])) == [] and substrings._HASHES
    assert list(common.trimmed(iter)([])) == [] and not substrings._HASHES
