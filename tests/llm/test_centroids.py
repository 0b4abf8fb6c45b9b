import hashlib

import numpy as np
import pytest

from lectern.llm import centroids


def plain(rows, k=40, rounds=5, dims=64, scale=256, seed=2):
    """k-means in Python integers; rows (vec_id, list or None)."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), np.array(v, np.int32).tobytes()) for i, v in kept if i is not None)[:k]
    cs = [np.frombuffer(b, np.int32).tolist() for _, b in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    if not cs:
        return []
    for _ in range(rounds):
        home = [min(range(len(cs)), key=lambda j: (far(v, cs[j]), j)) for _, v in kept]
        for j in range(len(cs)):
            own = [v for (_, v), h in zip(kept, home, strict=True) if h == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    home = [min((far(v, c), j) for j, c in enumerate(cs)) for _, v in kept]
    each = [sum(d for d, j in home if j == c) for c in range(len(cs))]
    return [(i, j, d, each[j], sum(each), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, home, strict=True)]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_screening_against_exact_distances():
    """Large integers, where float32 products are off by far more than the gaps between centroids, and ties."""
    rng = np.random.default_rng(3)
    for big in (3, 300, 1 << 20, centroids.LARGEST):
        c = rng.integers(-big, big + 1, (17, 64))
        c[5], c[9] = c[2], c[2] + np.eye(64, dtype=np.int64)[0]
        v = np.concatenate((rng.integers(-big, big + 1, (200, 64)), c, (c[2] + c[9]) // 2 + np.zeros((1, 64), np.int64)))
        v = np.clip(v, -centroids.LARGEST, centroids.LARGEST)
        exact = ((v[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (centroids.nearest(v.astype(np.int32), c) == exact).all()


def test_clusters_against_plain_version_with_edge_cases(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 64).astype(np.float32)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65), (204, [float("nan")] + [0.1] * 63), (205, [float("inf")] + [0.1] * 63), (206, [None] + [0.1] * 63)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[7][1]), (208, [0.0] * 64), (209, [-0.001] * 64), (210, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, cluster int").repartition(5)
    for k, rounds in ((40, 5), (7, 3), (500, 1)):
        assert order(centroids.clusters(df, k, rounds).collect()) == order(plain(rows, k, rounds))
    assert centroids.clusters(df.limit(0)).count() == 0
    assert centroids.clusters(df.where("vec_id is null")).count() == 0
    assert centroids.clusters(df.where("vec_id = 200")).count() == 0
    double = df.selectExpr("vec_id", "cast(embedding as array<double>) as embedding")
    assert order(centroids.clusters(double).collect()) == order(plain(rows))


def test_other_sizes_and_an_empty_cluster(spark):
    """Two equal starts: the second stays empty and keeps its centroid."""
    rows = [(i, [float(i % 2), 1.0, -0.25]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.clusters(df, 4, 2, 3, 10, 9).collect()
    assert order(got) == order(plain(rows, 4, 2, 3, 10, 9)) and len({r.cluster for r in got}) == 2


def test_values_that_would_overflow_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="overflow"):
        centroids.clusters(df).collect()


def test_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert order(centroids.op12_centroids(spark, sf).collect()) == order(plain(rows))
