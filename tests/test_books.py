"""Readers, section trees, scenes, narrative, sessions, export, preparation, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import export, narrative, prepare, scenes, sections, sessions
from lectern.sources import books
from lectern.streaming import reviews


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def make_epub(body, toc=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/content.opf"/></rootfiles></container>')
        z.writestr("OPS/content.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Книга</dc:title></metadata><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a%20x.xhtml" media-type="application/xhtml+xml"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="n"><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OPS/a x.xhtml", "<html><body><h1>Часть</h1><h2>Глава 1</h2>" + body + "</body></html>")
        z.writestr("OPS/b.xhtml", "<html><body><h2>Глава 2</h2><p>Конец.</p></body></html>")
        z.writestr("OPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{toc}</navMap></ncx>')
    return out.getvalue()


def point(label, src, inner=""):
    return f'<navPoint><navLabel><text>{label}</text></navLabel><content src="{src}"/>{inner}</navPoint>'


def test_read_books(spark, tmp_path):
    toc = point("Часть", "a%20x.xhtml", point("ГЛАВА 1.", "a%20x.xhtml#x") + point("вторая", "b.xhtml"))
    (tmp_path / "one.epub").write_bytes(make_epub('<p>Текст <sup>1</sup> .</p><aside epub:type="footnote"><p>Сноска</p></aside><blockquote class="epigraph"><p>Эпиграф</p><blockquote>Автор</blockquote></blockquote>', toc))
    (tmp_path / "two.md").write_text("# Book\n\nIntro\nline\n\n## One #\n```\n# no heading\n```\ntail\n\n## Two\n\nend", encoding="utf-8")
    (tmp_path / "bad.epub").write_bytes(b"nothing")
    (tmp_path / "x.txt").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r for r in books.read(spark, str(tmp_path)).collect()}
    assert got["bad.epub"].error and got["x.txt"].error
    one = got["one.epub"]
    assert one.title == "Книга" and [e.text for e in one.elements] == ["Часть", "Глава 1", "Текст 1 .", "Сноска", "Эпиграф", "Автор", "Глава 2", "Конец."]
    assert [e.is_note for e in one.elements][3] and one.elements[5].is_attribution and one.elements[4].epigraph_group == 1
    assert [(c.pos, c.depth) for c in one.contents] == [(0, 0), (1, 1), (6, 1)]
    two = got["two.md"]
    assert two.title == "Book" and [e.text for e in two.elements] == ["Book", "Intro line", "One", "``` # no heading ``` tail", "Two", "end"]
    all_ = books.read(spark, str(tmp_path))
    el = books.elements(all_)
    for r in all_.where("error is null").collect():
        text = "\n".join(e.text for e in r.elements)
        assert all(text[x.start_char : x.end_char] == x.text for x in el.where(F.col("book_id") == r.book_id).collect())
    toc_rows = all_.where("error is null").select("book_id", F.explode("contents").alias("c")).select("book_id", "c.*")
    tree = sections.build(el, toc_rows)
    assert rows(tree.where(F.col("book_id") == one.book_id), "start", "end", "level", "role") == [(1, 6, 1, "chapter"), (6, 8, 1, "chapter")]
    assert rows(tree.where(F.col("book_id") == two.book_id), "start", "end", "role", "title") == [(2, 4, "chapter", "One"), (4, 6, "chapter", "Two")]
    new, conflicts = books.first_import(spark.createDataFrame([(one.book_id, "other"), (two.book_id, two.text_hash)], "book_id string, text_hash string"), all_)
    assert new.count() == 0 and rows(conflicts, "book_id") == [(one.book_id,)]


def test_section_assembly():
    got = sections.assemble("k", [{"start": 0, "end": None, "level": 1, "role": "work", "title": "w", "title_position": 0}, {"start": 0, "end": None, "level": 2, "role": "chapter", "title": "a", "title_position": 0}, {"start": 0, "end": None, "level": 2, "role": "chapter", "title": "b", "title_position": 0}, {"start": 4, "end": None, "level": 2, "role": "chapter", "title": "c", "title_position": 4}, {"start": 2, "end": 3, "level": 3, "role": "epigraph", "title": None, "title_position": None}], 8)
    by = {(r["start"], r["role"], r["problem"] is None): r for r in got}
    assert by[0, "work", True]["end"] == 8 and by[0, "chapter", True]["end"] == 4 and by[4, "chapter", True]["end"] == 8
    assert by[4, "chapter", True]["parent_id"] == by[0, "work", True]["id"] and by[2, "epigraph", True]["parent_id"] == by[0, "chapter", True]["id"]
    assert (0, "chapter", False) in by
    assert [(p["role"], p["level"]) for p in sections.from_headings([(0, 1, "A"), (3, 1, "B"), (4, 2, "c")], 9)] == [("work", 1), ("work", 1), ("chapter", 2)]
    assert sections.from_headings([], 5)[0]["end"] == 5


def test_scene_segmentation_and_edits(spark):
    text = ["A one. ", "A two.\n\n", "B one. ", "B two."]
    at = [0, 7, 15, 22]
    units = spark.createDataFrame([("c", i, at[i], t) for i, t in enumerate(text)], "chapter_id string, unit int, start_char int, text string")
    got = scenes.segment(units)
    assert rows(got, "start_char", "end_char", "status") == [(0, 15, "ready"), (15, 28, "ready")]
    assert scenes.coverage_violations(got, units).count() == 0
    assert rows(scenes.segment(units, lambda *_: {}), "status", "start_char") == [("failed", None)]
    assert scenes.segment(units, most=5).first().status == "failed"
    one = [{"chapter_id": "c", "scene_id": "s1", "start_char": 0, "end_char": 15}, {"chapter_id": "c", "scene_id": "s2", "start_char": 15, "end_char": 28}]
    cut = scenes.split(one, "s1", 7)
    assert [(s["start_char"], s["end_char"]) for s in cut] == [(0, 7), (7, 15), (15, 28)]
    assert [(s["start_char"], s["end_char"]) for s in scenes.merge_next(cut, "s1")] == [(0, 15), (15, 28)]
    assert [s["end_char"] for s in scenes.move_boundary(one, "s1", 20)] == [20, 28]
    for bad in (lambda: scenes.split(one, "s1", 15), lambda: scenes.merge_next(one, "s2"), lambda: scenes.move_boundary(one, "s1", 28), lambda: scenes.scene_list({"continues_previous": True, "scenes": []}, 0, 2, False)):
        with pytest.raises(ValueError):
            bad()
    assert scenes.scene_list({"continues_previous": False, "scenes": [{"end_unit": 0, "title": "a", "summary": "b"}, {"end_unit": 1, "title": "c", "summary": "d"}]}, 0, 2, False)[0][1][:2] == (1, 2)


def test_annotations_and_events(spark):
    sc = spark.createDataFrame([("s", 2, ["e1", "e2"], "Он ушёл. Он пришёл."), ("t", 1, [], "Ночь.")], "scene_id string, n_chunks int, entity_ids array<string>, text string")
    schema = "scene_id string, chunk int, context string, representation string, level string, embedded_kind string, speaker_entity_id string"
    good = [("s", 1, " c ", "narrator", "primary", None, "e1"), ("s", 2, "d", "thought", "embedded", "dream", None)]
    ok, bad = narrative.chunk_annotations(spark.createDataFrame([*good, ("t", 1, "x", "song", "primary", None, None)], schema), sc.drop("text"))
    assert rows(ok, "chunk", "context") == [(1, "c"), (2, "d")] and rows(bad, "scene_id", "problem") == [("t", "representation")]
    ok, bad = narrative.chunk_annotations(spark.createDataFrame(good[:1], schema), sc.drop("text"))
    assert ok.count() == 0 and rows(bad, "scene_id", "problem") == [("s", "missing chunk"), ("t", "missing chunk")]
    ev = "scene_id string, seq int, surface_text string, occurrence int, gist string, gist_roles string, kind string, modality string, participants array<struct<entity_id:string,role:string>>, from_location string, to_location string"
    e = [("s", 1, "Он", 2, "g", "r", "process", "actual", [("e1", "a")], None, None), ("s", 2, "Он", None, "g", "r", "process", "actual", [("e1", "a")], None, None), ("s", 3, "ушёл", None, "g", "r", "state", "actual", [("e9", "a")], None, None)]
    ok, bad = narrative.event_rows(spark.createDataFrame(e, ev), sc.drop("n_chunks"))
    assert rows(ok, "start_offset", "end_offset") == [(9, 11)] and rows(bad, "seq", "problem") == [(2, "surface_text"), (3, "participants")]


def test_links(spark):
    ev = "book_id string, id string, scene_id string, position int, roles array<double>, story array<double>, people array<string>, retold boolean"
    e = [("k", "a", "1", 0, [1.0, 0.0], [1.0, 0.0], ["p"], False), ("k", "b", "2", 5, [1.0, 0.1], [0.0, 1.0], ["q"], False), ("k", "c", "3", 9, [0.0, 1.0], [-1.0, 0.0], ["p"], True)]
    known = spark.createDataFrame([("k", "c", "b")], "book_id string, a_id string, b_id string")
    got = narrative.shortlist(spark.createDataFrame(e, ev), known, k=1)
    assert rows(got, "left_id", "right_id", "required") == [("a", "b", False), ("a", "c", True), ("b", "c", True)]
    pairs = spark.createDataFrame([("1", "a", "b"), ("2", "a", "c"), ("3", "b", "c")], "pair_id string, left_id string, right_id string")
    rep = "pair_id string, seq int, type string, subtype string, direction string, basis string, confidence double, reason string"
    replies = [("1", 1, "huh", None, None, None, None, None), ("1", 2, "retells", "letter", "right_to_left", "explicit", 1.5, " a  b "), ("1", 3, "none", None, None, None, None, None), ("2", 1, "parallels", "letter", "left_to_right", "guess", float("nan"), "x" * 300)]
    d = narrative.link_decisions(pairs, spark.createDataFrame(replies, rep))
    assert rows(d, "pair_id", "type", "subtype", "direction", "basis", "confidence") == [("1", "retells", "letter", "right_to_left", "explicit", 1.0), ("2", "parallels", None, None, None, None), ("3", "none", None, None, None, 0.0)]
    assert max(len(r.reason) for r in d.collect()) == 200
    assert rows(narrative.link_rows(d), "source_id", "target_id", "directed") == [("a", "c", False), ("b", "a", True)]
    s = spark.createDataFrame([("k", n) for n in range(1, 9)], "book_id string, n int")
    focus = narrative.focus_groups(s).withColumn("group", F.col("group").cast("int"))
    sl = "book_id string, group int, seq int, a int, b int, type string, subtype string, direction string, basis string, reason string"
    l = [("k", 0, 1, 3, 1, "causes", None, "a_to_b", "inferred", "r"), ("k", 1, 1, 1, 3, "causes", None, None, None, ""), ("k", 1, 2, 7, 3, "retells", "rumor", "b_to_a", None, ""), ("k", 0, 3, 1, 99, "causes", None, None, None, ""), ("k", 0, 4, 2, 2, "causes", None, None, None, "")]
    got = narrative.scene_links(spark.createDataFrame(l, sl), s, focus)
    assert rows(got, "a", "b", "direction", "found") == [(1, 3, "b_to_a", 1), (3, 7, "a_to_b", 1)]
    o = spark.createDataFrame([("k", 1, "Глава", "Сцена", "Долгая суть. И ещё."), ("k", 2, "Глава", "Конец", "Всё.")], "book_id string, n int, chapter string, title string, summary string")
    assert narrative.outline(o, 1000).first().gist_chars == 160 and narrative.outline(o, 45).first().gist_chars == 0 and narrative.outline(o, 5).first().lines is None


def test_versions_and_chats(spark, tmp_path):
    t = sessions.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.version() == 0 and t.write(spark.range(3), 0) == 1
    with pytest.raises(sessions.Conflict):
        t.write(spark.range(9), 0)
    assert t.write(spark.range(4), 1) == 2 and t.read().count() == 4 and t.read(1).count() == 3
    m = spark.createDataFrame([("c", 1, "user", " hello "), ("c", 2, "assistant", "hi")], "conversation_id string, position int, role string, text string")
    new = spark.createDataFrame([("c", 5, "user", "b"), ("c", 4, "user", "a"), ("d", 1, "user", "z" * 90)], "conversation_id string, seq int, role string, text string")
    got = sessions.append_messages(m, new)
    assert rows(got.where("position > 2 or conversation_id = 'd'"), "conversation_id", "position", "text") == [("c", 3, "a"), ("c", 4, "b"), ("d", 1, "z" * 90)]
    assert rows(sessions.chat_titles(got), "title") == [("hello",), ("z" * 60,)]
    r = spark.createDataFrame([("r", i, 40) for i in range(5)], "run_id string, seq int, tokens int")
    assert rows(sessions.within_budget(r, 10, 100), "seq", "allowed") == [(0, True), (1, True), (2, False), (3, False), (4, False)]
    s = spark.createDataFrame([("x", "k", 1, [(True, "relevant", True), (False, "unreviewed", False)]), ("y", "k", 2, [])], "search_id string, book_id string, updated_at int, items array<struct<viewed:boolean,review_status:string,selected:boolean>>")
    first = sessions.recent(s, "k", 1, 1).first()
    assert (first.search_id, first.n_items, first.n_viewed, first.n_relevant, first.n_selected) == ("x", 2, 1, 1, 1)


def test_export(spark, tmp_path):
    schema = "search_id string, ord int, id string, text string, start_char int, end_char int, review_status string, reason string, selected boolean, selected_ranges array<struct<start_char:int,end_char:int>>, sections array<struct<title:string,role:string>>, path string, scores map<string,double>, query string"
    items = spark.createDataFrame([("s", 0, "10:20", "abcdefghij", 10, 20, "relevant", "r", True, [(12, 14)], [("T", "chapter"), (None, "part")], None, {"words:text": 0.1, "semantic": 0.2}, "q"), ("s", 1, "x", "y", 0, 1, "rejected", None, False, [], [], None, {}, "q")], schema)
    got = export.rows(items)
    assert rows(got, "n", "quote", "section", "how") == [(1, "cd", "T / part", "по смыслу; по словам")]
    assert export.rows(items, True).count() == 2 and export.markdown(got).first().markdown.startswith("## T / part · символы 10–20 · Подходит\n*r*\n\n> cd")
    export.write_csv(got.drop("search_id"), f"file://{tmp_path}/csv")
    assert any(p.read_text().startswith('"﻿n"') for p in (tmp_path / "csv").glob("*.csv"))


def test_preparation_isolates_failures(spark):
    chapters = spark.createDataFrame([("a",), ("b",)], "chapter_id string")
    seen = {}

    def scenes_stage(tables, left):
        return left, left.select("chapter_id", (F.col("chapter_id") != "a").alias("ok"), F.lit("d").alias("detail"))

    def later(tables, left):
        seen["left"] = [r.chapter_id for r in left.collect()]
        return None, None

    def broken(tables, left):
        raise ValueError("no")

    _, errors, out = prepare.run(prepare.Plan({"links": later, "scenes": scenes_stage, "index": broken}), {}, chapters)
    assert seen["left"] == ["b"] and errors == [("index", "ValueError: no")] and out.where("not ok").count() == 1
    with pytest.raises(ValueError):
        prepare.run(prepare.Plan({"index": broken}, continue_on_error=False), {}, chapters)


def test_review_stream(spark, tmp_path):
    src, schema = tmp_path / "in", "search_id string, id string, status string, ts timestamp"
    t = sessions.VersionedTable(spark, f"file://{tmp_path}/t")
    batch = lambda data: spark.createDataFrame(data, "search_id string, id string, status string, t string").selectExpr("search_id", "id", "status", "cast(t as timestamp) as ts").write.mode("append").parquet(str(src))
    batch([("s", "1", "relevant", "2024-01-01 00:00:00"), ("s", "1", "rejected", "2024-01-01 00:01:00")])
    go = lambda: spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(reviews.upsert_into(t)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    go()
    batch([("s", "1", "uncertain", "2023-01-01 00:00:00"), ("s", "2", "relevant", "2024-01-01 00:00:00")])
    go()
    assert rows(t.read(), "id", "status") == [("1", "rejected"), ("2", "relevant")]
    q = reviews.counts(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName("n").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("n").agg(F.sum("n")).first()[0] == 4
