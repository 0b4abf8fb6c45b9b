import math
import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import topk


def brute(rows, k, every):
    ok = {(i, tuple(max(-(2**63), min(2**63 - 1, math.floor(1024 * x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in ok:
        if i % every == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in ok if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(2)
    f32 = lambda: float(np.float32(rng.gauss(0, 1)))
    centres = [[f32() * 3 for _ in range(8)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + f32() / 4)) for c in rng.choice(centres)]) for i in range(600)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(150)] + [(2000, None), (None, same), (2010, [None] * 8), (2020, [float("nan")] * 8), (2030, [float("inf")] * 8)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3010, []), (3011, []), (0, rows[0][1]), (10, same)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    for sizes in ({}, {"shard_rows": 90, "block_rows": 20}):
        got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, 10, **sizes).collect())
        assert got == brute(rows, 10, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.randint(0, 17) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, 4).collect())
    want = brute(rows, 4, 5)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]


def test_tree_prunes():
    rng = np.random.default_rng(1)
    v = rng.integers(-1000, 1000, (4000, 4))
    t = topk.BallTree(np.arange(4000), v)
    seen = []
    t.scores = lambda q, a, b, f=t.scores: (seen.append((b - a) * len(q)), f(q, a, b))[1]
    t.search(np.arange(20), v[:20], 5, np.full(20, -(2**63)))
    assert sum(seen) < 0.5 * 20 * 4000


def test_few_shards_are_visited(spark):
    """On clustered vectors a query goes to few of the shards, and every row is in one shard."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 6)) * 4
    v = np.concatenate([c + rng.normal(0, 0.05, (50, 6)) for c in centres])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    probed, found, visits, shards = topk._found(df, F.col("vec_id") % 20 == 0, 5, 60, 30)
    assert shards > 25 and 100 + visits.count() < 0.5 * 100 * shards
    got = sorted(tuple(r) for r in topk._ranked(probed, found, 5).collect())
    assert got == brute(rows, 5, 20)


def test_best_bound_first():
    """The leaves of one query are opened in the order of their bounds."""
    rng = np.random.default_rng(2)
    v = rng.integers(-1000, 1000, (3000, 3))
    t = topk.BallTree(np.arange(3000), v)
    q = rng.integers(-1000, 1000, (1, 3))
    seen = []
    t.scores = lambda x, a, b, f=t.scores: (seen.append((a, b)), f(x, a, b))[1]
    t.search(np.array([-1]), q, 5, np.array([-(2**63)]))
    bound, parts = {}, {}

    def down(i, above):
        a, b, left, right = t.nodes[i]
        bound[i] = min(above, float(t.bounds(i, q.astype(float), np.sqrt((q * q).sum(1)))[0]))
        if left < 0:
            parts[a, b] = bound[i]
        else:
            down(left, bound[i]), down(right, bound[i])

    down(0, float("inf"))
    opened = [parts[x] for x in seen]
    assert opened == sorted(opened, reverse=True) and len(opened) < len(parts)
