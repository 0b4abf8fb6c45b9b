import random
import zlib

import numpy as np

from lectern.llm import quality


def fitted(bodies, y, epochs):
    order = np.random.default_rng(5).permutation(len(y))
    batches = lambda: (([bodies[j] for j in order[a : a + 32]], np.array(y)[order[a : a + 32]]) for a in range(0, len(y), 32))
    return quality.Network().fit(batches, len(y), sum(y), epochs)


def plain_score(net, body):
    """The network by loops: embed, convolve at every place, pool in every chunk, combine."""
    p, w, s = net.p, quality.WIDTH, quality.STRIDE
    places = max(1, -(-max(0, len(body) - w) // s) + 1)
    x = body + bytes((places - 1) * s + w - len(body) if (places - 1) * s + w > len(body) else 0)
    y = np.array([sum(p["embed"][x[a * s + j]] @ p["conv"][j] for j in range(w)) for a in range(places)])
    half = quality.CHUNK // 2 // s
    n = -(-places // half)
    chunks = [y[c * half : (c + 2) * half] for c in range(max(1, n - 1))]
    c = np.array([np.maximum(k.max(0) + p["shift"], 0) for k in chunks])
    return 1 / (1 + np.exp(-(c.max(0) @ p["top"] + c.mean(0) @ p["mean"] + p["bias"][0])))


def test_score_against_loops():
    rng = random.Random(3)
    bodies = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 11, 12, 13, 16, 255, 300, 511, 512, 700, 1500, 5000)]
    net = fitted(bodies, [i % 2 for i in range(len(bodies))], 3)
    assert np.allclose(net.score(bodies), [plain_score(net, b) for b in bodies], atol=1e-5)


def test_pooling_covers_the_whole_text():
    """A junk passage at any place of a long text, the end too, moves the largest value of a filter."""
    rng = random.Random(1)
    good = lambda n: " ".join(rng.choice(["river", "stone", "under", "the", "old"]) for _ in range(n))
    junk = "$$$ ### %%% &&& " * 20
    texts = [good(200) for _ in range(150)] + [good(rng.randint(0, 150)) + junk + good(rng.randint(0, 150)) for _ in range(150)]
    net = fitted([t.encode() for t in texts], [1] * 150 + [0] * 150, epochs=6)
    far = good(60000)
    s = net.score([far.encode(), (far + junk).encode(), (junk + far).encode()])
    assert np.isfinite(s).all() and s[1] < s[0] and s[2] < s[0]
    old, quality.PLACES = quality.PLACES, quality._HALF * 4
    assert np.allclose(net.score([(far + junk).encode()]), s[1], atol=1e-5)
    quality.PLACES = old
    assert len(net.score([b"", b"a", b"\xff" * 13])) == 3


def test_query_on_held_out_rows_and_edge_cases(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        docs.append((i, " ".join(rng.choice(["the", "of", "and", "river", "stone"]) + ("$$$" if bad else "") for _ in range(60)), 1.0, True))
        labels.append((i, int(not bad), "x"))
    docs += [(900, None, 0.0, False), (901, "", 0.0, False), (None, "river", 0.0, False), (5, docs[5][1], 1.0, True), (902, "stone " * 90000, 0.0, True)]
    labels += [(None, 1, "x"), (901, None, "x"), (77777, 1, "x"), (7, 1, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double, held_out boolean")
    l = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = quality.quality(d, l).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert held and np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in quality.quality(d, l.limit(0)).collect()} == {0.5}
    assert quality.quality(d.limit(0), l).count() == 0
