"""The search service over a small book."""

import pytest

from lectern.operators import sessions
from lectern.service import Search, quotes_of, render

TEXT = ("Пётр ехал в степи. Метель выла. " * 4 + "\n") + ("Маша ждала письма. Дом молчал. " * 4 + "\n") + ("Пётр вернулся домой. Маша плакала. " * 4)


@pytest.fixture(scope="module")
def book(spark):
    n = [i for i, c in enumerate(TEXT) if c == "\n"]
    a, b, z = n[0], n[1], len(TEXT)
    df = spark.createDataFrame
    return {
        "books": df([("k", TEXT, 1, 1)], "book_id string, text string, revision int, generation int"),
        "sections": df([("k", "w", None, "W", "work", 0, z), ("k", "c1", "w", "1", "chapter", 0, b), ("k", "c2", "w", "2", "chapter", b + 1, z)], "book_id string, id string, parent_id string, title string, role string, start_char int, end_char int"),
        "blocks": df([("k", "c1", "epigraph", 0, 18)], "book_id string, section_id string, role string, start_char int, end_char int"),
        "scenes": df([("k", "s1", 0, a, "Дорога", "Метель", "ready", 1, [1.0, 0.0]), ("k", "s2", a + 1, b, "Дом", "Маша ждёт", "ready", 2, [0.0, 1.0]), ("k", "s3", b + 1, z, "Встреча", "Пётр дома", "partial", 3, [1.0, 1.0])], "book_id string, id string, start_char int, end_char int, title string, summary string, status string, scene_rank int, summary_embedding array<double>"),
        "chunks": df([("k", "x1", "s1", 0, a, TEXT[0:a], [1.0, 0.0]), ("k", "x2", "s2", a + 1, b, TEXT[a + 1 : b], [0.0, 1.0]), ("k", "x3", "s3", b + 1, z, TEXT[b + 1 : z], [0.7, 0.7])], "book_id string, id string, scene_id string, start_char int, end_char int, text string, embedding array<double>"),
        "presence": df([("p", "s1"), ("p", "s3"), ("m", "s2"), ("m", "s3")], "entity_id string, scene_id string"),
        "entities": df([("p", "Пётр", ["Петруша"], "person", 2), ("m", "Маша", [], "person", 2)], "id string, canonical_name string, aliases array<string>, entity_type string, scene_count int"),
        "scene_links": df([("s1", "s3", "prefigures", "inferred", "буря")], "source_id string, target_id string, type string, basis string, reason string"),
    }


def test_channels(spark, book):
    s = Search(book, "k")
    assert [c.start_char for c in s.words("пётр метель").candidates.orderBy("ord").collect()][0] == 18  # less the epigraph
    assert [c.scene_ids for c in s.scenes_for_entities(["p", "m"]).candidates.collect()] == [["s3"]]
    e = {c.scene_ids[0]: c for c in s.expand(["s1"], ["character", "prefiguring", "composition"]).candidates.collect()}
    assert set(e["s3"].scores) == {"character", "prefiguring"} and "буря" in e["s3"].path and set(e["s2"].scores) == {"composition"}
    for bad in (lambda: s.words(" "), lambda: s.words("x", limit=0), lambda: s.words("x", limit=True), lambda: s.expand(["s1"], ["odd"]), lambda: s.graph(["s1"], 4)):
        with pytest.raises(ValueError):
            bad()


def test_review_and_answer(spark, book):
    s = Search(book, "k")
    r = s.words("метель")
    page = s.page(r, size=1).collect()
    assert page[0].text == TEXT[page[0].start_char : page[0].end_char] and page[0].next_offset is None
    v = spark.createDataFrame([(page[0].id, "relevant", "да", "метель выла", 1)], "id string, status string, reason string, evidence string, seq int")
    q = quotes_of(s.review(r, v)).collect()
    assert [(x.marker, x.quote) for x in q] == [("F1", "Метель выла.")]
    assert render("Вот: [[F1]] и [[F9]]", {x.marker: x.quote for x in q}) == "Вот: \n> Метель выла.\n и (фрагмент не подтверждён)"
    stale = Search({**book, "books": book["books"].selectExpr("book_id", "text", "2 as revision", "generation")}, "k")
    with pytest.raises(sessions.Conflict):
        stale.page(r)
