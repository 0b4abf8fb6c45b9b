"""Operators on small fixtures: intervals, chunks, search, verdicts, entities."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import spans
from lectern.functions import text as T
from lectern.operators import entities, intervals, search, structure, vectors
from lectern.sources import html


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_interval_subtraction(spark):
    base = spark.createDataFrame([("b", 100, 500)], "book_id string, start_char long, end_char long")
    holes = spark.createDataFrame([("b", 100, 140), ("b", 420, 460)], "book_id string, start_char long, end_char long")
    assert rows(intervals.subtract(base, holes, ["book_id"]), "start_char", "end_char") == [(140, 420), (460, 500)]


@pytest.mark.parametrize("width", [1, 7, 50, 1000])
def test_overlap_join_equals_nested_loop(spark, width):
    rng = random.Random(width)
    iv = lambda n: [(rng.randrange(2), i, s := rng.randrange(200), s + rng.randrange(30)) for i in range(n)]
    a, b = iv(60), iv(80)
    schema = "k int, id int, start_char long, end_char long"
    got = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], width)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and x[3] > y[2] and x[2] < x[3] and y[2] < y[3])
    assert rows(got, "left_id", "right_id") == want


def test_chunks_glue_and_split():
    text = "\n".join(["Короткая строка."] * 5 + ["x" * 900, "  ", "Слово два. " * 300])
    found = spans.chunk_spans(text)
    assert all(0 < b - a <= 1200 for a, b in found) and found == sorted(found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    kept = "".join(text[a:b] for a, b in found)
    assert kept.replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert spans.chunk_spans("") == [] and spans.chunk_spans("y" * 2500) == [(0, 1200), (1200, 2400), (2400, 2500)]
    with pytest.raises(ValueError):
        spans.chunk_spans("a", 10, 100)


def test_evidence_is_widened_to_sentences():
    text = "Первое дело. Он сказал: «Ещё рано»! Потом ушёл."
    a, b = spans.evidence(text, "ЕЩЕ — рано")
    assert text[a:b] == "Он сказал: «Ещё рано»!"
    assert spans.evidence(text, "он") is None and spans.evidence(text, "нет такого") is None
    assert spans.resolve("a b a", "a", None, None, 2) == (4, 5) and spans.resolve("a b a", "a", None, None, None) is None
    assert spans.resolve("a b a", "b", 2, 3, None) == (2, 3) and spans.occurrences("cat cats cat", "cat") == [(0, 3), (9, 12)]


def test_round_robin_skips_what_is_out(spark):
    items = spark.createDataFrame([("s", "x", {"A": 1 / 61, "B": 1 / 61}), ("s", "y", {"A": 1 / 62}), ("s", "z", {"B": 1 / 62})], "search_id string, id string, scores map<string,double>")
    assert [r.id for r in search.round_robin(items).orderBy("ord").collect()] == ["x", "z", "y"]


def test_candidates_keep_scores_paths_and_inner_anchors(spark):
    schema = "search_id string, channel string, rank int, id string, start_char long, end_char long, origin string, path string, anchor_start long, anchor_end long"
    hits = spark.createDataFrame([("s", "entity", 1, "s1", 10, 60, "scene", "p", 30, 38), ("s", "words", 2, "c1", 10, 60, "chunk", None, None, None), ("s", "words", 1, "c2", 50, 90, "chunk", None, 55, 95)], schema)
    ranges = spark.createDataFrame([(0, 70)], "start_char long, end_char long")
    got = {r.id: r for r in search.candidates(hits, ranges).collect()}
    assert got["10:60"].scores == {"entity": pytest.approx(1 / 61), "words": pytest.approx(1 / 62)}
    assert got["10:60"].scene_ids == ["s1"] and got["10:60"].path == "p" and got["10:60"].anchors[0].start_char == 30
    assert got["50:70"].anchors == [] and got["50:70"].scene_ids == []


def test_merge_conflicts_and_selection(spark):
    schema = "search_no int, id string, scores map<string,double>, review_status string, selected boolean, viewed boolean"
    items = spark.createDataFrame([(0, "a", {"w": 0.1}, "relevant", True, False), (1, "a", {"w": 0.2, "v": 0.1}, "rejected", False, True), (0, "b", {"w": 0.3}, "unreviewed", False, False), (1, "b", {"w": 0.1}, "relevant", True, False), (0, "c", {"w": 0.1}, "rejected", True, False)], schema)
    got = {r.id: r for r in search.merge_searches(items).collect()}
    assert (got["a"].review_status, got["a"].selected, got["a"].viewed, got["a"].scores) == ("uncertain", False, True, {"w": 0.2, "v": 0.1})
    assert (got["b"].review_status, got["b"].selected) == ("relevant", True)
    assert (got["c"].review_status, got["c"].selected) == ("rejected", False)


def test_verdicts(spark):
    items = spark.createDataFrame([("1", "Снег шёл. Он вошёл в дом. Стало тепло.", 100), ("2", "Другое.", 200), ("3", "Третье.", 300)], "id string, text string, start_char int")
    verdicts = spark.createDataFrame([("1", "relevant", " ok ", "ВОШЕЛ В ДОМ", 1), ("2", "rejected", "no", "", 2), ("9", "relevant", "", "", 3)], "id string, status string, reason string, evidence string, seq int")
    got = {r.id: r for r in search.apply_verdicts(items, verdicts).collect()}
    assert got["1"].quote == "Он вошёл в дом." and got["1"].verified and got["1"].quote_start == 110 and got["1"].reason == "ok"
    assert got["2"].review_status == "rejected" and not got["2"].selected and got["3"].review_status == "unreviewed"


def test_paging_is_whole(spark):
    items = spark.createDataFrame([("s", i, "unreviewed") for i in range(7)], "search_id string, ord long, review_status string")
    seen, offset = [], 0
    while offset is not None:
        got = search.page(items, offset, 3).orderBy("ord").collect()
        seen += [r.ord for r in got]
        offset = got[0].next_offset
    assert seen == list(range(7))


def test_sections_and_blocks(spark):
    edges = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "r")], "id string, parent_id string")
    got = structure.closure(edges, edges.where("id = 'a'"), depth=3)
    assert rows(got, "id", "level") == [("a", 0), ("b", 1)]
    lines = spark.createDataFrame([("k", i, t) for i, t in enumerate(["Title", "epi", "author", "body", "note"])], "book_id string, pos int, element string")
    sections = spark.createDataFrame([("k", "s", 1, 5)], "book_id string, id string, body_start int, body_end int")
    notes = spark.createDataFrame([("k", "s", "epigraph", 1, 3), ("k", "s", "footnotes", 4, 5)], "book_id string, section_id string, role string, start int, end int")
    assert rows(structure.content_blocks(lines, sections, notes), "role", "text") == [("body", "body"), ("epigraph", "epi\nauthor"), ("footnotes", "note")]
    s = spark.createDataFrame([("k", "1", None, 0, 0), ("k", "2", "1", 2, 1), ("k", "3", "1", 5, 1), ("k", "4", "2", 3, 2)], "book_id string, id string, parent_id string, start int, level int").withColumn("total", F.lit(9))
    assert rows(structure.next_bound(s), "id", "end") == [("1", 9), ("2", 5), ("3", 9), ("4", 5)]


def test_html_blocks():
    page = '<title>t</title><h1>A <b>b</b></h1><p>one<br>two</p><script>x</script><aside epub:type="footnote"><p>n</p></aside><blockquote class="epigraph"><p>q</p><blockquote>au</blockquote></blockquote>tail'
    got = [(b["type"], b["text"], b["heading_level"], b["is_note"], b["epigraph_group"], b["is_attribution"]) for b in html.parse(page)]
    assert got == [("Title", "A b", 1, False, None, False), ("NarrativeText", "one two", None, False, None, False), ("NarrativeText", "n", None, True, None, False), ("NarrativeText", "q", None, False, 1, False), ("NarrativeText", "au", None, False, 1, True)]
    assert html.parse(None) == [] and html.parse("<p>") == []


def test_mentions(spark):
    replies = spark.createDataFrame([("s", 1, "Пётр", 0, 4, None, "person", 0.9), ("s", 2, "Её", None, None, None, "person", 0.9), ("s", 3, "Пётр", 0, 4, None, "person", 0.5), ("s", 4, "Москва", None, None, 1, "planet", 0.5), ("s", 5, "Москва", None, None, 1, "location", 2.0), ("s", 6, "Москва", None, None, None, "location", 1.0), ("x", 7, "A", None, None, None, None, 1.0)], "scene_id string, seq int, surface_text string, start_offset int, end_offset int, occurrence int, entity_type string, confidence double")
    scenes = spark.createDataFrame([("s", "Пётр видел Москва. Её нет.", "h")], "scene_id string, text string, text_hash string")
    good, bad = entities.mention_rows(replies, scenes)
    # a pronoun of the list that is written with ё is looked up with е and so not found
    assert rows(good, "surface_text", "start_offset") == [("Её", 19), ("Москва", 11), ("Пётр", 0)]
    assert dict(rows(bad, "seq", "problem")) == {3: "repeated span", 4: "type", 5: "confidence", 7: "unknown scene"}


def test_unions(spark):
    members = spark.createDataFrame([("k", x) for x in "abcd"], "book_id string, id string")
    same = spark.createDataFrame([("k", "a", "b"), ("k", "b", "c"), ("k", "c", "d")], "book_id string, a string, b string")
    assert rows(entities.conservative_groups(same, members), "id", "root") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    assert {r.root for r in entities.connected(edges).collect()} == {0, 100}


def test_text_functions(spark):
    df = spark.createDataFrame([(" a  b ", "Ёлка's ёлка", "title: x/y")], "a string, b string, c string")
    r = df.select(T.clean(F.col("a")).alias("clean"), T.normalised_name(F.col("b")).alias("name"), T.slug(F.col("c")).alias("slug"), T.any_of(F.col("b")).alias("q")).first()
    assert (r.clean, r.name, r.slug) == ("a b", "елка s елка", "title-x-y") and r.q.startswith('"')
    got = vectors.embed(spark.createDataFrame([("h", "a b"), ("i", "")], "hash string, text string"), vectors.hashing_embedder(8)).collect()
    assert {len(x.embedding) for x in got} == {8}
