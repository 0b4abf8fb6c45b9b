"""Guards of the writes, versions, imports, resolution, judging and the command line."""

import pytest
from pyspark.sql import functions as F

from lectern.__main__ import main
from lectern.operators import editing, judging, lexical, resolution, scenes, sessions, structure, writes
from lectern.plans.write_queries import library
from lectern.sources import books, html, imports

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_changed_sources_are_refused(spark):
    t = library(spark, SF)
    s = t["scenes"].limit(3).select("book_id", "chapter_id", F.col("id").alias("scene_id"), (F.col("text_hash") + 1).alias("text_hash"))
    with pytest.raises(sessions.Conflict):
        writes.replace_mentions(t, s, t["mentions"].limit(0), t["references"].limit(0))
    with pytest.raises(sessions.Conflict):
        writes.replace_annotations(t, s.drop("chapter_id"), t["annotations"].limit(0), t["events"].limit(0))
    ch = t["layers"].limit(1).select("book_id", "chapter_id")
    with pytest.raises(sessions.Conflict):
        writes.replace_chapter_entities(t, ch, t["mentions"].limit(0).select("book_id", "id", "scene_text_hash"), t["chapter_entities"].limit(0))
    with pytest.raises(sessions.Conflict):
        writes.apply_flat(t, spark.createDataFrame([(1, -5, 1)], "book_id long, mention_id long, entity_id long"), t["entities"])
    links = t["scene_links"].limit(1).withColumns({"source_hash": F.lit(-7), "target_hash": F.lit(-7)})
    with pytest.raises(sessions.Conflict):
        writes.replace_scene_links(t, links.select("book_id"), links)
    source = t["books"].limit(1).select("book_id", "revision", "text_hash", F.lit("g0").alias("generation"))
    with pytest.raises(sessions.Conflict):
        writes.replace_index(t, source, t["chunks"].limit(0), t["chunks"].limit(0), "m")


def test_versions_survive_a_lost_writer(spark, tmp_path):
    t = sessions.VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() == 0 and t.write(spark.range(1), 0) == 1
    spark.range(5).write.parquet(str(tmp_path / "t" / "_new-lost"))  # a writer that died before its rename
    assert t.version() == 1 and t.write(spark.range(2), 1) == 2 and t.read().count() == 2
    assert t.undo(2) == 3 and t.read().count() == 1 and t.read(2).count() == 2
    with pytest.raises(sessions.Conflict):
        t.write(spark.range(1), 1)


def test_imports(spark, tmp_path):
    path = str(tmp_path / "once")
    assert imports.write_once(spark, path, spark.range(3)) and not imports.write_once(spark, path, spark.range(3))
    with pytest.raises(sessions.Conflict):
        imports.write_once(spark, path, spark.range(4))
    import hashlib
    import json

    texts = ["a", 'b "c"\n\t\\', "ё…", ""]
    want = hashlib.sha256(json.dumps(texts, ensure_ascii=False).encode()).hexdigest()
    assert spark.createDataFrame([(texts,)], "t array<string>").select(imports.list_hash(F.col("t")).alias("h")).first().h == want
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\none\ntwo", encoding="utf-8")
    assert books.read(spark, str(tmp_path / "in")).first().text_hash == hashlib.sha256(json.dumps(["T", "one two"]).encode()).hexdigest()


def test_html_follows_the_open_block():
    text = lambda page: [b["text"] for b in html.parse(page)]
    assert text("loose<p>foo<b>bar</b></p>tail") == ["foo bar"]
    assert text("<div>a<p>b</p>c</div><p>d") == ["a", "b", "d"]
    assert text("<p>a<script>x<p>y</p></script>b</p><title>t</title>") == ["a b"]
    notes = html.parse('<p class="note">a</p><p class="Footnote x">b</p><h1 class="footnote">c</h1><table class="endnote"><td>d</td></table><li role="doc-endnote">e</li>')
    assert [b["is_note"] for b in notes] == [False, True, False, False, True]
    quoted = html.parse('<section role="doc-epigraph"><blockquote>q<blockquote>a</blockquote></blockquote></section><p class="epigraph">p</p><div class="epigraph"><p>r</p></div>')
    assert [(b["epigraph_group"], b["is_attribution"]) for b in quoted] == [(1, False), (1, True), (None, False), (2, False)]


def test_next_bounds(spark):
    s = [(0, 1), (2, 2), (2, 3), (4, 3), (6, 2), (8, 1), (9, 2)]
    df = spark.createDataFrame([("k", a, n, 12) for a, n in s], "book_id string, start int, level int, total int")
    want = [(a, n, min([b for b, m in s if b > a and m <= n], default=12)) for a, n in s]
    assert rows(structure.next_bound(df), "start", "level", "end") == sorted(want, key=str)


def cluster(i, name, kind="person", **more):
    return resolution.Cluster(i, name, kind, "new", **more)


def test_names():
    assert resolution.stems("Капитанская дочка") == ["капитанск", "дочк"] and resolution.canonical([" Пётр ", "Пётр Гринёв", None, "Петра Гринёва"]) == "Пётр Гринёв"
    assert resolution.grounded("Мария Иванова", ["Марию Иванову"]) == "Мария Иванова" and resolution.grounded("Иван", ["Пугачёв"]) is None and resolution.grounded(" ", ["a"]) is None
    a, b, c = cluster("a", "Пётр"), cluster("b", "Петра"), cluster("c", "Белогорск", "location")
    assert [x.id for x in resolution.ranked("Пётр", "person", 3, [b, c, a], 5)] == ["a", "b"]
    assert list(resolution.shortlist_pairs([a, b, c], 2)) == [("a", "b")]
    assert resolution.unions("abc", {("a", "b"): "SAME_ENTITY", ("b", "c"): "SAME_ENTITY", ("a", "c"): "UNCERTAIN"}) == {"a": "a", "b": "a", "c": "c"}
    with pytest.raises(ValueError):
        resolution.ranked("x", None, 0, [], 0)


def test_replies_are_checked():
    batch = [{"id": x} for x in "abcd"]
    reply = {"resolutions": [{"mention_ids": ["a"], "entity_id": "e"}, {"mention_ids": ["a", "b"], "unresolved": True}, {"mention_ids": ["b"], "entity_id": "no"}, {"mention_ids": ["c"], "new_entity": {"canonical_name": "N"}, "unresolved": True}, {"mention_ids": ["d"], "new_entity": {"canonical_name": "N"}}, 7]}
    got = resolution.checked_groups(reply, batch, {x: ["e"] for x in "abcd"})
    assert [(g["ids"], g["kind"], g["name"]) for g in got] == [(["a"], "existing", None), (["d"], "new", "N"), (["b"], "unresolved", None), (["c"], "unresolved", None)]
    pairs = {("a", "b"): 1.0, ("a", "c"): 0.5}
    said = {"decisions": [{"left_entity_id": "b", "right_entity_id": "a", "decision": "SAME_ENTITY"}, {"left_entity_id": "a", "right_entity_id": "b", "decision": "DIFFERENT_ENTITY"}, {"left_entity_id": "a", "right_entity_id": "c", "decision": "?"}]}
    assert resolution.decided(pairs, lambda p: said) == {("a", "b"): "SAME_ENTITY", ("a", "c"): "UNCERTAIN"}
    row = lambda d, e=None: {"chapter_entity_id": "s", "decision": d, "entity_id": e}
    assert resolution.checked_choice({"resolutions": [row("same_entity", "x")]}, "s", ["x"]) == ("same_entity", "x")
    assert resolution.checked_choice({"resolutions": [row("same_entity", "y"), row("new_entity")]}, "s", ["x"])[0] == "new_entity"
    assert resolution.checked_choice({"resolutions": [row("new_entity"), row("new_entity")]}, "s", [])[0] == resolution.checked_choice(None, "s", [])[0] == "uncertain"


def test_representatives_and_merges():
    a = cluster("b", "Пётр", evidence=[("1", "Пётр", "c1"), ("2", "Пётр Андреич", "c2"), ("3", "он", "c3"), ("4", "Петруша", "c1")], aliases=["Пётр"], mentions=["1"])
    assert a.representatives(2) == (["Пётр Андреич", "Петруша"], ["c1", "c3"])
    m = resolution.merged([a, cluster("a", "Пётр Гринёв", None, aliases=["Гринёв"], mentions=["5"])], 3)
    assert (m.id, m.name, m.kind, m.aliases, m.mentions, m.state) == ("a", "Пётр Гринёв", "person", ["Пётр", "Гринёв"], ["1", "5"], "reconciled")
    with pytest.raises(ValueError):
        resolution.fitting(a, [m], 10, 3)
    assert [r for _, r in resolution.extract([{"n": 1}, {"n": 2}], lambda p, n: {"finish_reason": "stop" if n >= 6000 * 2 * p["n"] else "length", "n": n})] == [{"finish_reason": "stop", "n": 12000}, {"finish_reason": "stop", "n": 24000}]


def test_judge_asks_once_more():
    asked = []

    def ask(batch, attempt):
        asked.append([c["id"] for c in batch])
        return None if attempt > 1 else [{"id": batch[0]["id"], "verdict": "partial"}, {"id": "zz", "verdict": "relevant"}, {"id": batch[-1]["id"], "verdict": "what"}]

    got, exhausted = judging.judge([{"id": x} for x in "abc"], ask)
    assert [(v["id"], v["status"]) for v in got] == [("a", "uncertain"), ("b", "uncertain")] and asked == [["a", "b", "c"], ["b", "c"]] and not exhausted
    assert judging.judge([{"id": "a"}], lambda b, n: None) == ([], True)


def test_preview():
    assert judging.preview({"a": 1}, 10, len) == ('{"a": 1}', False) and judging.preview("x" * 100, 5, len) == ("", True)
    cut, short = judging.preview("x" * 100, 60, len)
    assert short and len(cut) == 60 and cut.startswith('{"output_truncated": true')


def test_edits_with_faults_change_nothing(spark):
    s = spark.createDataFrame([("k", "s", 0, 9, 0, 3)], "book_id string, id string, start int, end int, title_position int, body_start int")
    b = spark.createDataFrame([("k", "A", "s", "epigraph", 1, 2, None)], "book_id string, id string, section_id string, role string, start int, end int, attribution_start int")
    e = spark.createDataFrame([("k", i, "NarrativeText") for i in range(9)], "book_id string, pos int, type string")
    for op, start, end, why in (("odd", 1, 2, "operation"), ("body", 0, 4, "title"), ("epigraph", 5, 6, "not an opening"), ("attribution", 5, 6, "no epigraph"), ("opening", 4, 40, "range")):
        edit = spark.createDataFrame([("k", "s", op, start, end)], "book_id string, section_id string, operation string, start int, end int")
        s2, b2, faults = editing.edit_openings(s, b, e, edit)
        assert rows(faults, "problem") == [(why,)] and s2.collect() == s.collect() and b2.collect() == b.collect()
    sections = s.withColumns({"level": F.lit(1), "role": F.lit("chapter"), "title": F.lit("t")}).unionByName(spark.createDataFrame([("k", "c", 2, 6, 2, 3, 2, "section", "u")], "book_id string, id string, start int, end int, title_position int, body_start int, level int, role string, title string"))
    el = e.withColumn("text", F.lit("x"))
    out, faults = editing.split_sections(sections, spark.createDataFrame([("k", "s", 4)], "book_id string, id string, at int"), el)
    assert rows(faults, "id", "problem") == [("s", "crosses a section")] and out.count() == 2
    out, faults = editing.split_sections(sections, spark.createDataFrame([("k", "c", 4), ("k", "s", 7)], "book_id string, id string, at int"), el)
    assert faults.count() == 0 and rows(out, "start", "end", "level") == [(0, 7, 1), (2, 4, 2), (4, 6, 2), (7, 9, 1)]


def test_chapter_input_ignores_the_title():
    chapter = {"id": "c", "start": 0, "end": 5, "role": "chapter", "title": "a"}
    same = scenes.chapter_input("h", chapter | {"title": "b"}, [{"role": "body", "start": 0, "end": 5}])
    assert scenes.chapter_input("h", chapter, []) == same != scenes.chapter_input("h", chapter, [{"role": "epigraph", "start": 1, "end": 2}])


def test_phrases_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 3)
    docs = spark.createDataFrame([(1, "a b c b"), (2, None), (3, ""), (4, "ccc")], "id long, text string")
    phrases = spark.createDataFrame([(1, "b"), (2, "b"), (3, "c b"), (4, ""), (5, None), (6, "cc")], "p long, t string")
    assert rows(lexical.containing(docs, "id", phrases, "p", "t"), "id", "p", "start") == [(1, 1, 2), (1, 2, 2), (1, 3, 4), (4, 6, 0)]
    assert lexical.containing(docs, "id", phrases.limit(0), "p", "t").count() == 0


def test_command_line(spark, tmp_path, capsys):
    assert main(["queries"]) == 0 and "q_lexical_bm25" in capsys.readouterr().out
    assert main(["index", f"{SF}/documents.parquet", str(tmp_path / "ix")], spark) == 0
    assert main(["words", str(tmp_path / "ix"), "the", "--rows", "3"], spark) == 0 and "score" in capsys.readouterr().out
    assert main(["run", "q_unique_violations", SF, "--rows", "2"], spark) == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\none", encoding="utf-8")
    assert main(["import", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 0 and spark.read.parquet(str(tmp_path / "out" / "elements")).count() == 2
