import random
import re
import zlib
from collections import Counter

import pytest

from lectern.llm import variants


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, length=6, least=5, times=5):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in total.items() if k >= least and len(w) >= length}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_apart(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_automaton_numbers_and_completions():
    rng = random.Random(2)
    pool = sorted({"".join(rng.choice("abà") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    m = variants.Automaton(pool)
    assert m.size == len(pool) and [m.follow(m.start, 0, w) for w in pool] == list(range(len(pool)))
    assert m.follow(m.start, 0, "abc") == -1 and variants.Automaton([]).near("abcdef", 0, 6) == set()
    for w in pool[::7]:
        assert {pool[i] for i in m.near(w, 0, len(w))} == {x for x in pool if len(x) >= len(w) and one_apart(w, x)}
        half = len(w) // 2
        assert {pool[i] for i in m.near(w, half, len(w))} >= {x for x in pool if len(x) >= len(w) and one_apart(w, x) and x[: half + 1] != w[: half + 1] and x[:half] == w[:half]}
    some = variants.Automaton(sorted(a + b for a in ("auto", "demo", "re") for b in ("mat", "mate", "mates")))
    assert len(some.edges) == 13  # common endings are one state; without sharing there were 26


@pytest.mark.parametrize("group", [20_000, 3])
def test_variants_against_plain_version(spark, monkeypatch, group):
    """Runs of equal letters, accents, words that differ at either end; with small groups every half is cut again and again."""
    monkeypatch.setattr(variants, "GROUP", group)
    monkeypatch.setattr(variants, "BLOCK", 40)
    monkeypatch.setattr(variants, "PIECE", 50)
    rng = random.Random(group)
    stems = ["aaaaaa", "abcdef", "Zürichér", "bananas", "ßÀabcd×q", "mmmmmmmm", "abababab"]
    pool = list(stems)
    for _ in range(150):
        w = rng.choice(pool)
        i = rng.randrange(len(w) + 1)
        pool.append(rng.choice([w[:i] + rng.choice("abmÀz") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abcx") + w[i + 1 :]]))
    docs = [(k, " ".join(rng.choices(pool, [1 / (j + 1) for j in range(len(pool))], k=60)) + rng.choice([".", "1", "ı", "Āa"])) for k in range(120)]
    docs += [(None, docs[1][1]), (3, docs[3][1]), (500, None), (501, ""), (502, "abcdef " * 3000), (503, "a" * 500), (504, "12 ¿!")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, root string").repartition(4)
    result = got(variants.variants(df))
    assert result == plain(docs) and len(result) > 50
    assert any(f is not None and r != f for _, f, r, *_ in result)
    assert got(variants.variants(df.limit(0))) == [] and got(variants.variants(df.where("doc_id in (500, 501, 504)"))) == []


def test_other_thresholds(spark):
    rows = [(i, "colour color colors Colours colouring") for i in range(7)] + [(i, "color " * 9) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(variants.variants(df, 5, 2, 3)) == plain(rows, 5, 2, 3)


def test_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(20)]
    df = spark.createDataFrame(chain, "word string, form string")
    assert {tuple(r) for r in variants.roots(df).collect()} == {(w, "w20") for w, _ in chain}
