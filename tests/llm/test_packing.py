import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing


def best_fit(histogram, capacity):
    rooms = []
    import bisect
    n = 0
    for length in sorted(Counter(histogram).elements(), reverse=True):
        i = bisect.bisect_left(rooms, length)
        if i == len(rooms):
            n += 1
            room = capacity
        else:
            room = rooms.pop(i)
        bisect.insort(rooms, room - length)
    return n


@pytest.mark.parametrize("kind", ["mixed", "thirds", "few", "small", "one"])
def test_plan_is_exact_and_tight(kind):
    rng = np.random.default_rng(3)
    n = {
        "mixed": np.clip(rng.lognormal(6.4, 0.9, 20000), 1, 2048).astype(int),
        "thirds": rng.integers(600, 760, 6000),
        "few": rng.integers(1, 2049, 60),
        "small": rng.integers(1, 200, 5000),
        "one": np.array([683] * 3000),
    }[kind]
    h = Counter(n.tolist())
    classes = packing.plan(h)
    used = Counter()
    for times, lengths in classes:
        assert times > 0 and sum(a * c for a, c in lengths) <= 2048
        for a, c in lengths:
            used[a] += times * c
    assert used == h
    count, least = sum(t for t, _ in classes), -(-int(n.sum()) // 2048)
    assert count <= max(best_fit(h, 2048) * 1.002, least * 1.005) + 1
    if kind == "mixed":
        assert count <= least * 1.005 + 1


def test_whole_packing(spark):
    rng = random.Random(1)
    odd = ["", None, "The CAT's <|endoftext|> n'est", "Ünïcode é ́x a\xa0b\x1cc d\x85e", "日本語 text 😀!", "x" * 9000, " \n ", "Élan, ÀÇÉ!! naïve?! Œuvre ĂĎ. ªb µm ºC ßß. e\u0301t\u0301. I\u0307x \u0130stanbul it's. A.B a..b ....", "<|startoftext|>, x<|endoftext|>."]
    texts = [*odd, "stone River, " * 20_000] + [" ".join(rng.choice(["stone", "River,", "un-der", "9 11", "Ol'd", "ção."]) for _ in range(rng.choice([3, 50, 400, 3000]))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "lost"), (3, texts[3])]
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, sequence_id int, piece string")
    got = packing.packed(df, keep_ids=True).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            p = ids[k : k + 2048]
            want.append((i, k // 2048, k, len(p), zlib.crc32(p.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.packed(df.limit(0)).count() == 0


def test_ranks_are_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    df = spark.range(500).selectExpr("id as doc_id", "cast(case when id < 300 then 700 else 1 + id % 90 end as long) as length")
    got = packing.pack(df).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 500
    bins = Counter()
    for r in got:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= 151
