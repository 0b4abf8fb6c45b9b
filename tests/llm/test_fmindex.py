import random

import numpy as np

from lectern.llm.fmindex import FMIndex, Wavelet


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 37, 1000)
    w = Wavelet(v, 6)
    s, at = rng.integers(0, 40, 300), rng.integers(0, 1001, 300)
    assert (w.rank(s, at) == [(v[:a] == x).sum() for x, a in zip(s, at, strict=True)]).all()


def test_matching_statistics_against_brute_force():
    rng = random.Random(2)
    for depth in (5, 8):
        pieces = [np.array([rng.randrange(4) for _ in range(rng.randint(0, 40))], np.int64) for _ in range(12)]
        owner = np.array([rng.randrange(100) for _ in pieces])
        streams = [np.array([rng.randrange(5) for _ in range(rng.randint(0, 60))], np.int64) for _ in range(9)] + pieces
        found, least, begin = FMIndex(pieces, owner, depth).matching_statistics(streams)
        for k, s in enumerate(streams):
            for i in range(len(s)):
                best, low = 0, -1
                for ell in range(1, depth + 1):
                    run = list(s[i : i + ell])
                    if len(run) < ell:
                        break
                    hits = [o for p, o in zip(pieces, owner, strict=True) if any(list(p[j : j + ell]) == run for j in range(len(p) - ell + 1))]
                    if hits:
                        best, low = ell, (min(hits) if ell == depth else -1)
                assert (found[begin[k] + i], least[begin[k] + i]) == (best, low)
