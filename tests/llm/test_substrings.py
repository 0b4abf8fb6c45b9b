import hashlib
import random

import pytest

from lectern.llm import substrings


def brute(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    order = [2**63 - 1 if d is None else d for d, _ in rows]
    least = {}
    for o, w in zip(order, words):
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            least[k] = min(least.get(k, o), o)
    out = []
    for (d, _), o, w in zip(rows, order, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < o:
                gone.update(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def table(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrst") + rng.choice("uvwxyz") for _ in range(n))
    shared = [text(rng.randint(40, 140)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), text(rng.randint(0, 30))]
        rows.append((rng.randint(0, 400), rng.choice(["", "\n", "  "]).join([""]) + " \n".join(parts)))
    base = text(300)
    for i in range(30):
        w = base.split()
        w[rng.randrange(300)] = f"x{i}"
        rows.append((500 + i, " ".join(w)))
    rows += [(d, t) for d, t in rows[:5]] + [(1000 + d, t) for d, t in rows[:8]]
    rows += [(2000, None), (2001, ""), (None, shared[0]), (None, base), (2002, "tick " * 3000), (2003, "tick " * 200 + "tock"), (2004, "a\x1cb \x85c"), (2005, " ".join(shared[1].split()[:49]))]
    return rows


@pytest.mark.parametrize("hot", [1000, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "PIECE", 64)
    rows = table(hot)
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, ord int, h string, spans int")
    got = substrings.removals(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute(rows, 50), key=str)


def test_texts_after_removal_and_empty_table(spark):
    rows = table(9)
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, ord int, h string, spans int")
    got = substrings.without_repeats(df).collect()
    want = [x for x, (_, t) in zip(brute(rows, 50), rows) if not (x[1] and x[1] == x[2])]
    sha = lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
    assert sorted((str(r.doc_id), sha(r.text)) for r in got) == sorted((str(w[0]), w[3]) for w in want)
    assert got[0].asDict().keys() == {"doc_id", "text", "ord", "h", "spans"}
    assert {r.text for r in got if r.doc_id in (2000, 2001)} == {None, ""}
    assert substrings.removals(df.limit(0)).count() == 0 and substrings.without_repeats(df.limit(0)).count() == 0
