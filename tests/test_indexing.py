"""The index of a library of two books, and the consistency of all tables after every write."""

import pytest
from pyspark.sql import functions as F

from lectern import library
from lectern.operators import structure, vectors, writes
from lectern.plans.cascade_queries import whole

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def two_books(spark):
    df = spark.createDataFrame
    return {
        "books": df([("a", "A", "ha", 1), ("b", "B", "hb", 1)], "book_id string, text string, text_hash string, revision int"),
        "layers": df([("a", "c1", "ready"), ("b", "c1", "partial")], "book_id string, chapter_id string, status string"),
        "scenes": df([("a", "c1", "s1", 0, 20, "Метель", "снег"), ("b", "c1", "s1", 0, 9, "Дом", None), ("b", "c1", "s2", 9, 20, " ", "")], "book_id string, chapter_id string, id string, start_char int, end_char int, title string, summary string"),
        "chunks": df([("a", "c1", "s1", "x1", 0, 10, "метель выла"), ("a", "c1", "s1", "x2", 10, 20, "дом молчал"), ("b", "c1", "s1", "y1", 0, 9, "дом молчал")], "book_id string, chapter_id string, scene_id string, id string, start_char int, end_char int, text string"),
        "annotations": df([("a", "x2", "ночью"), ("b", "y1", "")], "book_id string, chunk_id string, context string"),
        "index_state": df([], "book_id string, generation string, text_hash string"),
    }


def test_a_rebuild_touches_one_book_and_embeds_only_misses(spark, tmp_path):
    lib = library.Library(spark, str(tmp_path), buckets=8)
    lib.save(two_books(spark), 0)
    one = lambda b: spark.createDataFrame([(b,)], "book_id string")
    embed = lambda misses: vectors.embed(misses, vectors.hashing_embedder(8))
    report: dict = {}
    library.rebuild_index(lib, "m", embed, one("a"), report=report)
    assert report["embedded"] == 3  # two chunks, one with its context, and a summary
    first = lib.tables()
    kept = {n: rows(first[n].where("book_id = 'a'"), *first[n].columns) for n in ("chunks", "postings", "posting_stats", "summary_embeddings", "index_state")}
    assert all(kept.values())
    library.rebuild_index(lib, "m", embed, one("b"), report=report)
    assert report["embedded"] == 2  # its chunk has no context, so it is another input; the scene without words has none
    both = lib.tables()
    for name, old in kept.items():
        assert rows(both[name].where("book_id = 'a'"), *first[name].columns) == old
        assert both[name].where("book_id = 'b'").count() > 0
    library.rebuild_index(lib, "m", embed, one("a"), report=report)
    assert report["embedded"] == 0
    again = lib.tables()
    assert rows(again["chunks"].where("book_id = 'a'"), "id", "embedding") == rows(both["chunks"].where("book_id = 'a'"), "id", "embedding")
    library.rebuild_index(lib, "m2", embed, one("a"), spark.createDataFrame([("a", "other")], "book_id string, chapter_id string"), report)
    assert report["embedded"] == 0 and {r.embedding for r in lib.tables()["chunks"].where("book_id = 'a'").collect()} == {None}  # another model, another chapter
    library.rebuild_index(lib, "m", None, one("b"), report=report)
    assert report["embedded"] == 0 and lib.tables()["chunks"].where("book_id = 'b' and embedding is not null").count() == 1
    bad = lambda misses: misses.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0)))
    with pytest.raises(ValueError):
        library.rebuild_index(lib, "m3", bad, one("a"))


def test_an_edit_of_one_book_writes_its_bucket_only(spark, tmp_path):
    lib = library.Library(spark, str(tmp_path), buckets=16)
    rows_ = [(f"b{i}", i) for i in range(40)]
    lib.save({"t": spark.createDataFrame(rows_, "book_id string, n int"), "u": spark.createDataFrame([], "book_id string, n int"), "plain": spark.range(2)}, 0)
    before = {(f.name, f.bucket): f.path for f in lib._files(1)}
    book = spark.createDataFrame([("b7",)], "book_id string")
    seen = []

    def make(t):
        seen.append(t["t"].count())
        return t | {"t": t["t"].where("book_id <> 'b7'"), "u": t["u"].unionByName(t["t"].where("book_id = 'b7'"))}

    lib.edit(make, "move", books=book)
    after = {(f.name, f.bucket): f.path for f in lib._files(2)}
    changed = {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    assert seen[0] < 40 and len({b for n, b in changed if n == "t"}) == 1 and {n for n, _ in changed} <= {"t", "u"}
    t = lib.tables()
    assert rows(t["t"], "book_id", "n") == sorted(((b, n) for b, n in rows_ if b != "b7"), key=str) and rows(t["u"], "book_id", "n") == [("b7", 7)] and t["plain"].count() == 2
    lib.undo(2)
    assert lib.tables()["t"].count() == 40 and lib.tables()["u"].count() == 0


def test_no_write_leaves_a_key_missing(spark):
    """Scene layers and sections, whose removal reaches most tables; the queries q_cascade_* hold the other writes against SQL."""
    t = whole(spark, SF)
    some = spark.createDataFrame([(40,), (80,)], "book_id long")
    t = {n: spark.createDataFrame(writes.only(v, some, {"book_id": "book_id"}).collect(), v.schema) for n, v in t.items()}
    done = {
        "nothing": t,
        "layers": writes.write_layers(t, t["layers"], t["scenes"].where("id % 3 <> 0")),
        "sections": writes.cascade(t, {"sections": t["sections"].where("id < '2'").select("book_id", "id")}),
    }
    for name, out in done.items():
        assert writes.missing(out).collect() == [], name


def test_cascade_goes_down_trees_and_leaves_the_rest_alone(spark):
    df = spark.createDataFrame
    t = {
        "sections": df([("k", "w", None), ("k", "c", "w"), ("k", "d", "c"), ("k", "e", None), ("j", "c", None)], "book_id string, id string, parent_id string"),
        "blocks": df([("k", "d", "b1"), ("k", "e", "b2"), ("j", "c", "b3"), ("k", None, "b4")], "book_id string, section_id string, id string"),
        "entities": df([("k", "p")], "book_id string, id string"),
    }
    out = writes.cascade(t, {"sections": df([("k", "c")], "book_id string, id string")})
    assert rows(out["sections"], "book_id", "id") == [("j", "c"), ("k", "e"), ("k", "w")]
    assert rows(out["blocks"], "id") == [("b2",), ("b3",), ("b4",)] and out["entities"] is t["entities"]


def test_bounds_of_any_level_and_circles(spark):
    import random

    rng = random.Random(4)
    s = [("k", rng.randrange(60), rng.choice([0, 3, 10, 17, 30, None]), 99) for _ in range(150)] + [("l", None, 1, 5), ("l", 2, 12, 5), (None, 1, 1, 7)]
    df = spark.createDataFrame(s, "book_id string, start int, level int, total int").repartition(3)

    def end(b, a, n, total):
        return total if a is None or n is None else min((x for k, x, m, _ in s if k == b and x is not None and m is not None and x > a and m <= n), default=total)

    assert rows(structure.next_bound(df), "book_id", "start", "level", "end") == sorted(((b, a, n, end(b, a, n, t)) for b, a, n, t in s), key=str)
    ring = spark.createDataFrame([("x", "z"), ("y", "x"), ("z", "y"), ("t", None)], "id string, parent_id string")
    assert rows(structure.closure(ring, ring.where("id = 'x'")), "root", "id", "level") == [("x", "x", 0), ("x", "y", 1), ("x", "z", 2)]
