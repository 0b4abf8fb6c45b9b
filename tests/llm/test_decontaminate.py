import random

import numpy as np

from lectern.llm import decontaminate as dc


def semiglobal(p, t):
    """Smallest edit distance of p to any part of t."""
    d = list(range(len(p) + 1))
    best = d[-1]
    for c in t:
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(d[i - 1] + (p[i - 1] != c), d[i] + 1, new[-1] + 1))
        d = new
        best = min(best, d[-1])
    return best


def reduce_plain(s):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in s).split())


def test_reduced():
    m, at = dc.reduced("  Élan, (vital)!\n Two  ")
    assert "".join(map(chr, m)) == "élan vital two" and at[0] == 2
    assert dc.reduced("")[0].size == 0 and dc.reduced(" ..")[0].size == 0


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeghlmnoprstu") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 40))).capitalize() + ".") for i in range(12)]
    items += [(50, None), (51, ""), (52, "Xyzzy"), (53, "..."), (54, items[0][1])]
    docs = []
    for i in range(90):
        parts = [" ".join(word() for _ in range(rng.randint(0, 50)))]
        if i % 2:
            t = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, len(t) // 7)):
                j = rng.randrange(len(t))
                t[j] = rng.choice(["", "q", t[j] + "k", t[j].upper(), t[j] + " "])
            parts.append("".join(t))
        parts.append(" ".join(word() for _ in range(rng.randint(0, 50))))
        docs.append((i, "\n".join(parts)))
    docs += [(200, None), (201, ""), (None, "x " + items[3][1]), (203, "say XYZZY, twice"), (204, "xyzzyx"), (3, docs[3][1])]
    made = dc.Items(items)
    want = set()
    for d, t in docs:
        r = reduce_plain(t or "")
        for k, (i, s) in enumerate(items):
            p = reduce_plain(s or "")
            if p and r:
                if len(p) < dc.Q:
                    if f" {p} " in f" {r} ":
                        want.add((d, i, 0))
                else:
                    e = semiglobal(p, r)
                    if e <= made.budget[k]:
                        want.add((d, i, e))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, start string")
    bf = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = dc.matches(df, bf).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == want and len(want) > 30
    by = dict(docs)
    for r in got:
        part = reduce_plain(by[r.doc_id][r.start : r.end])
        s = reduce_plain(dict(items)[r.item_id])
        assert semiglobal(s, part) == r.edits and abs(len(part) - len(s)) <= r.budget
    kept = {r.doc_id for r in dc.without_leaks(df, bf).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _, _ in want}
    assert dc.matches(df.limit(0), bf).count() == 0 and dc.matches(df, bf.limit(0)).count() == 0


def test_long_text_and_blocks(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew bitter potions in silence"
    monkeypatch.setattr(dc, "TEXT_CHARS", 5000)
    far = "ab cd ef " * 40000 + item + " zz" * 3000
    made = dc.Items([(1, item)])
    found = list(dc._batched(made, [far, None, item, "no " * 4000]))
    assert [(t, far[s:e] if t == 0 else s) for t, _, s, e, _ in found] == [(0, item), (2, 0)]
    monkeypatch.setattr(dc, "BLOCK_CHARS", 10)
    df = spark.createDataFrame([(1, far)], "doc_id long, text string")
    bf = spark.createDataFrame([(1, item), (2, item[::-1]), (3, item + " extra words here")], "item_id long, text string")
    assert sorted(r.item_id for r in dc.matches(df, bf).collect()) == [1]


def test_long_item_with_edits_to_one_side():
    """Insertions spread the shared grams over more diagonals than two bands have."""
    rng = random.Random(9)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000))
    text = "".join(c + "7" * (i % 11 == 10) for i, c in enumerate(item))
    items = dc.Items([(1, item)])
    edits = len(text) - len(item)
    assert edits <= items.budget[0]
    found = items.matches(dc.reduced("before " + text + " after")[0])
    assert [(k, s, e, d) for k, s, e, d in found] == [(0, 7, 7 + len(text), edits)]


def whole(items, text):
    """The result of a text read in one piece."""
    m, at = dc.reduced(text)
    return sorted((k, int(at[s]), int(at[e - 1]) + 1, d) for k, s, e, d in items.matches(m))


def test_windows_give_what_one_piece_gives(monkeypatch):
    """Items with edits, short items and much white space at every place of a window end."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    long = [" ".join(word() for _ in range(18)) for _ in range(2)]
    items = dc.Items([(1, long[0]), (2, long[1]), (3, "cat"), (4, "x y")])
    assert items.budget[0] > 0
    found = 0
    for at in range(0, 300, 3):
        edited = list(long[0])
        edited[30] = "q"
        edited[60] = ""
        spread = "".join(c if c != " " else " " * 10 + "...\n" for c in "".join(edited))
        text = "zz " * (at // 3) + spread + " concat " + "w" * (at % 7) + " cat. " + long[1] + " X  y" + " vv" * 50
        monkeypatch.setattr(dc, "TEXT_CHARS", 1 << 20)
        want = whole(items, text)
        for size in (97, 128, 200):
            monkeypatch.setattr(dc, "TEXT_CHARS", size)
            assert sorted((k, s, e, d) for _, k, s, e, d in dc._batched(items, [text])) == want
        assert {k for k, *_ in want} == {0, 1, 2, 3}
        assert "concat" not in text[want[2][1] - 3 : want[2][2]] and not text[want[2][2]].isalnum()
        found += len(want)
    assert found == 400


def test_slices_count_as_one(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("ab ") for _ in range(3000))
    items = dc.Items([(i, text[a : a + 60]) for i, a in enumerate(range(0, 2000, 77))] + [(99, "a" * 70)])
    m = dc.reduced(text + " " + "a" * 300)[0]
    want = [x.tolist() for x in items.candidates(m)]
    for pairs in (1, 7, 1000):
        monkeypatch.setattr(dc, "PAIRS", pairs)
        assert [x.tolist() for x in items.candidates(m)] == want


def test_one_letter_is_bounded():
    import tracemalloc

    items = dc.Items([(1, "a" * 300), (2, "ab" * 150)])
    tracemalloc.start()
    found = list(dc._batched(items, ["a" * 2_000_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(k, s, d) for _, k, s, _, d in found] == [(0, 0, 0)] and peak < 1 << 29


def test_leaks_go_row_by_row(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew potions"
    rows = [(None, "clean one", 1), (None, item, 2), (None, None, 3), (7, "say " + item, 4), (7, "clean too", 5), (8, "", 6), (9, "x" * 50, 7), (9, "x" * 50, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __body int")
    bf = spark.createDataFrame([(1, item), (2, "other item of the benchmark with many words")], "item_id long, text string")
    got = dc.without_leaks(df, bf)
    assert got.columns == df.columns and sorted(r["__body"] for r in got.collect()) == [1, 3, 5, 6, 7, 8]
    assert dc.without_leaks(df, bf.limit(0)).count() == 8 and dc.without_leaks(df.limit(0), bf).count() == 0


def test_letters_beyond_the_basic_plane():
    assert "".join(map(chr, dc.reduced("a\U0001f600b \U00010400")[0])) == "a b \U00010428"


def test_items_of_every_length_at_exactly_the_rate_of_edits():
    """Items of 10 to 200 letters with 10 % edits spread evenly, the worst case for shared grams, of every kind; one edit more is refused."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    for size in (9, 10, 19, 20, 29, 30, 45, 50, 65, 70, 79, 80, 81, 99, 100, 119, 150, 159, 160, 200):
        item = "".join(rng.choice(letters) for _ in range(size))
        made = dc.Items([(1, item)])
        k = size // 10
        assert made.budget.tolist() == [k]
        for kind in ("replace", "insert", "delete"):
            for edits in {k, k + 1}:
                t = list(item)
                for e in range(edits):
                    j = (2 * e + 1) * size // (2 * edits)
                    t[j] = {"replace": "é", "insert": t[j] + "é", "delete": ""}[kind]
                text = "some words before " + "".join(t) + " and some after"
                got = made.matches(dc.reduced(text)[0])
                least = semiglobal(item, reduce_plain(text))
                assert bool(got) == (least <= k), (size, kind, edits, got, least)
                assert not got or got[0][3] == least


def test_grams_are_those_of_each_run():
    rng = np.random.default_rng(2)
    m = rng.integers(97, 100, 60).astype(np.uint32)
    for q in (1, 3, 4, 6, 8, 9):
        h = dc.grams(m, q)
        runs = [tuple(m[i : i + q].tolist()) for i in range(len(m) - q + 1)]
        assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs)) == len(set(zip(h.tolist(), runs, strict=True)))
    assert len(dc.grams(m[:3], 4)) == 0
