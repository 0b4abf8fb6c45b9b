import random
import zlib

import numpy as np

from lectern.llm import toxicity


def test_pairwise_interaction_is_learnt():
    """Two words that mean nothing alone and are labelled together: linear weights can't, the machine can."""
    rng = random.Random(1)
    filler = [f"word{chr(97 + i)}" for i in range(20)]
    rows, y = [], []
    for _ in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(" ".join(rng.sample(filler, 3) + ["insultx"] * a + ["groupy"] * b))
        y.append(int(a == b))
    x = [toxicity.features(t) for t in rows]
    m = toxicity.Machine().fit(x[:2000], y[:2000], epochs=25)
    assert np.mean((m.score(x[2000:]) >= 0.5) == np.array(y[2000:])) > 0.95


def test_interaction_is_learnt_from_tables(spark):
    """The same two words through the tables: the choice of buckets keeps what only pairs tell."""
    rng = random.Random(1)
    filler = [f"word{chr(97 + i)}" for i in range(20)]
    docs, labels = [], []
    for i in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append((i, " ".join(rng.sample(filler, 3) + ["insultx"] * a + ["groupy"] * b)))
        labels.append((i, int(a == b)))
    y = dict(labels)
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    assert len(got) > 400 and np.mean([r.predicted == y[r.doc_id] for r in got]) >= 0.95


def test_joint_buckets():
    """Of buckets that say nothing alone, those that go along with the labels in pairs, in short rows and in long ones."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for i in range(1500):
        a, b = (bool(x) for x in rng.random(2) < 0.5)
        ids = np.unique(np.concatenate((rng.integers(100, 5000, 4 if i % 2 else 20), [7] * a, [9] * b))).astype(np.int64)
        rows.append((ids, np.ones(len(ids))))
        y.append(int(a == b) - 0.5)
    every = np.bincount(np.concatenate([a for a, _ in rows]), minlength=1 << toxicity.BITS)
    found = np.flatnonzero(toxicity.joint(iter(rows), np.array(y), every))
    assert {7, 9} <= set(found.tolist()) and len(found) < 10


def test_score_against_the_sum_over_pairs():
    rng = random.Random(5)
    words = ["abel", "brink", "cosy", "dune", "elder", "abet"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    x = [toxicity.features(t) for t in rows]
    m = toxicity.Machine().fit(x, [i % 2 for i in range(60)])
    for (ids, values), p in zip(x, m.score(x), strict=True):
        use = [(int(i), v) for i, v in zip(ids, values, strict=True) if m.known[i]]
        size = sum(v * v for _, v in use) ** 0.5 or 1
        use = [(i, v / size) for i, v in use]
        raw = m.bias + sum(m.w[i] * v for i, v in use)
        raw += sum((m.v[i] @ m.v[j]) * v * u for a, (i, v) in enumerate(use) for j, u in use[a + 1 :])
        assert abs(1 / (1 + np.exp(-raw)) - p) < 1e-9


def test_telling_buckets():
    """z of a share against the sample's, computed apart."""
    ones, every = np.array([10.0, 5, 2, 1, 0, 30]), np.array([10.0, 40, 4, 1, 25, 100])
    got = toxicity.telling(ones, every, 30, 100)
    z = [abs(o - e * 0.3) / (e * 0.3 * 0.7 * (1 - e / 100)) ** 0.5 if 2 <= e < 100 else 0 for o, e in zip(ones, every, strict=True)]
    assert got.tolist() == [x >= 2 for x in z] and got.tolist() == [True, True, False, False, True, False]
    assert not toxicity.telling(ones, every, 100, 100).any() and not toxicity.telling(ones, every, 0, 0).any()


def test_recall_on_held_out_labels(spark):
    """Label 1 of rows that weren't trained on, on the larger table."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.op1_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    assert np.mean([r.predicted for r in got if r.toxic == 1]) >= 0.85
    assert np.mean([r.predicted for r in got if r.toxic == 0]) <= 0.01


def test_query_on_held_out_rows_and_edge_cases(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        docs.append((i, " ".join(rng.choice(["the", "of", "and", "river", "stone"]) for _ in range(30)) + (" vile" if bad else ""), 1.0, True))
        labels.append((i, int(bad), "x"))
    docs += [(900, None, 0.0, False), (901, "", 0.0, False), (None, "vile river", 0.0, False), (5, docs[5][1], 1.0, True), (902, "vile " * 60000, 0.0, True)]
    labels += [(None, 1, "x"), (901, None, "x"), (77777, 1, "x"), (7, 1, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double, held_out boolean")
    l = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = toxicity.toxicity(d, l).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert held and np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in toxicity.toxicity(d, l.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(d.limit(0), l).count() == 0


def test_rare_words_count():
    rng = random.Random(4)
    filler = [f"word{chr(97 + i)}" for i in range(20)]
    rare = "vile scum trash idiot moron".split()  # in 8 of 400 texts each
    rows = [(" ".join(rng.sample(filler, 8)) + (f" {rare[i // 10 % 5]}" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(400)]
    m = toxicity.Machine().fit([toxicity.features(t) for t, _ in rows], [y for _, y in rows])
    new = [" ".join(rng.sample(filler, 8)) for _ in range(40)]
    assert (m.score([toxicity.features(t + " vile") for t in new]) >= 0.5).mean() > 0.9
    assert (m.score([toxicity.features(t) for t in new]) < 0.5).mean() > 0.9
