import itertools
import random

import numpy as np
import xxhash

from lectern.llm import simhash


def plain(text, k=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def alike(a, b, width, least):
    """Whether the Jaccard similarity of the shingles of two texts is ``least`` or more."""
    a, b = (set(simhash.shingles((t or "").encode(), width).tolist()) for t in (a, b))
    return len(a & b) >= least * len(a | b) > 0


def brute(rows, similar=None):
    fp = {i: plain(t) for i, (_, t) in enumerate(rows)}
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fp[i] ^ fp[j]).count("1") <= 4 or similar and alike(rows[i][1], rows[j][1], *similar):
            root[up(i)] = up(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[up(i)] = min(low.get(up(i), d), d)
    return sorted(((d, fp[i], low.get(up(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_anchors_meet_within_the_threshold():
    rng = random.Random(3)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        rows, keys = simhash.anchors(np.array([x, y], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])
    assert len(simhash.anchors(np.array([5], np.uint64))[0]) <= 34


def test_forest_spans():
    f = np.unique(np.array([0, 1, 3, 1 << 40, (1 << 40) | 7, 0xFFFF << 16], np.uint64))
    assert len(simhash.forest(f, 4)) == 4


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(90)) for _ in range(25)]
    rows = []
    for i, t in enumerate(base):
        rows.append((10 * i, t))
        w = t.split()
        for c in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "zz"
            rows.append((10 * i + c + 1, " ".join(v)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "one TWO"), (None, "x"), (None, base[0]), (900, None), (905, "é Éa"), (906, "word " * 70000)]
    df = spark.createDataFrame([(d, t, "c", 1, 2) for d, t in rows], "doc_id long, text string, fp string, root int, component int")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_similar_texts_beyond_the_threshold_go(spark):
    rng = random.Random(8)
    rows = []
    for g in range(20):
        w = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        v = list(w)
        for i in (20, 75, 130):
            v[i] = "changed"
        far = [x if i % 12 else "other" for i, x in enumerate(w)]
        rows += [(10 * g, " ".join(w)), (10 * g + 1, " ".join(v)), (10 * g + 2, " ".join(far))]
    rows += [(900, "A b"), (901, "a  B"), (902, "c"), (903, None), (904, "")]
    sets = [set(simhash.shingles((t or "").encode(), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        bits = bin(plain(rows[i][1]) ^ plain(rows[j][1])).count("1")
        if bits <= 4 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
            root[max(up(i), up(j))] = min(up(i), up(j))
    want = {rows[up(i)][0] for i in range(len(rows))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(df, similar=(5, 0.8)).collect()} == want
    assert len({r.doc_id for r in simhash.one_of_each(df).collect()}) > len(want)
    assert simhash.one_of_each(df.limit(0), similar=(5, 0.8)).count() == 0


def test_crowded_bands_give_all_links(spark, monkeypatch):
    """Many near copies of one text, some near to a few others only, with groups far above what a task compares."""
    monkeypatch.setattr(simhash, "GROUP", 12)
    monkeypatch.setattr(simhash, "PIVOTS", (3, 12))
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(140):
        w = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 3, 5])):
            w[j] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [set(simhash.shingles(t.encode(), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        bits = bin(plain(rows[i][1]) ^ plain(rows[j][1])).count("1")
        if bits <= 4 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[max(up(i), up(j))] = min(up(i), up(j))
    want = {rows[up(i)][0] for i in range(len(rows))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(df, similar=(5, 0.8)).collect()} == want and 3 < len(want) < 100
