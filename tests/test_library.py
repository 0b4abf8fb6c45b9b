"""The library of tables, entity service, index, and the agent's tools."""

import pytest
from pyspark.sql import functions as F

from lectern import library
from lectern.agent import Exhausted, Tools
from lectern.operators import judging, narrative, sessions, vectors, writes
from lectern.plans import resolution_queries
from lectern.plans.write_queries import library as order_tables
from lectern.service import Search
from tests.test_service import TEXT, book  # noqa: F401  the fixture

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_snapshots_edits_and_undo(spark, tmp_path):
    lib = library.Library(spark, str(tmp_path))
    one = lib.save({"a": spark.range(2), "b": spark.range(3)}, 0, "first")
    assert one == 1 and {k: v.count() for k, v in lib.tables().items()} == {"a": 2, "b": 3}
    raced = []

    def make(t):
        if not raced:  # another writer comes in between
            raced.append(lib.save({"b": spark.range(7)}, lib.revision(), "other"))
        return t | {"a": t["a"].union(t["b"])}

    assert lib.edit(make, "mine") == 3 and lib.tables()["a"].count() == 9 and lib.tables()["b"].count() == 7
    assert lib.tables(1)["b"].count() == 3
    with pytest.raises(sessions.Conflict):
        lib.save({"a": spark.range(1)}, 1)
    assert lib.undo(3) == 4 and {k: v.count() for k, v in lib.tables().items()} == {"a": 2, "b": 7}
    assert [x for _, x in lib.labels()] == ["other", "mine", "other", "first"]


def test_entities_and_index(spark, tmp_path):
    lib = library.Library(spark, str(tmp_path), buckets=2)
    t = order_tables(spark, SF)
    some = spark.createDataFrame([(b,) for b in (1, 2, 4)], "book_id long")
    t = {k: (writes.only(v, some, {"book_id": "book_id"}) if "book_id" in v.columns else v) for k, v in t.items()}
    t["scenes"] = t["scenes"].withColumn("text", F.lit("name one two"))
    t["mentions"] = t["mentions"].dropDuplicates(["id"]).withColumns({"id": F.col("id").cast("string"), "surface_text": F.concat(F.lit("N"), F.col("start_offset") % 200), "entity_type": F.lit("person"), "canonical_name_hint": F.lit(None).cast("string")})
    t["chapter_entities"] = spark.createDataFrame([], "book_id long, chapter_id string, id string, canonical_name string, entity_type string, aliases array<string>, mention_ids array<string>, scene_ids array<string>, canonical_hints array<string>, representative_mentions array<string>, representative_contexts array<string>, representative_references array<string>, resolution_state string")
    t["resolves"] = spark.createDataFrame([], "book_id long, chapter_entity_id string, book_entity_id string, decision string")
    t["book_entities"] = spark.createDataFrame([], "book_id long, id string, canonical_name string, entity_type string, aliases array<string>, canonical_hints array<string>, chapter_ids array<string>, scene_ids array<string>")
    t["chunks"] = t["chunks"].withColumns({"text": F.lit("Слова книгами"), "embedding": F.lit(None).cast("array<double>")})
    lib.save(t, 0)
    service = library.EntityService(lib, resolution_queries.by_surface, resolution_queries.by_name)
    service.resolve_chapters(t["layers"].select("book_id", "chapter_id"))
    made = lib.tables()
    assert library.pending_chapter_entities(made).count() == made["chapter_entities"].count() > 0
    forms = t["mentions"].join(t["scenes"].select("book_id", F.col("id").alias("scene_id"), "chapter_id"), ["book_id", "scene_id"])
    assert made["chapter_entities"].count() == forms.select("book_id", "chapter_id", "surface_text").distinct().count()
    service.resolve_books(some)
    after = lib.tables()
    assert rows(library.book_entities(after), "book_id", "canonical_name") == rows(forms.select("book_id", F.col("surface_text").alias("canonical_name")).distinct(), "book_id", "canonical_name")
    assert library.pending_chapter_entities(after).count() == 0
    assert library.scene_entities(after).count() == forms.select("scene_id", "surface_text").distinct().count()
    assert service.presence().count() == library.scene_entities(after).count()
    links = spark.createDataFrame([(r.book_id, r.id) for r in t["mentions"].limit(2).collect()], "book_id long, mention_id string").withColumn("entity_id", F.lit(1))
    assert library.unresolved_mentions(after | {"refers": links}).count() == t["mentions"].count() - 2
    embed = lambda c: c.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    revision, generation = library.rebuild_index(lib, "m", embed, some)
    state = lib.tables(revision)["index_state"]
    assert {r.generation for r in state.collect()} == {generation} and rows(lib.tables()["postings"].select("token").distinct(), "token") == [("книг",), ("слов",)]


def test_tools(spark, book):  # noqa: F811
    tables = book | {"chunks": book["chunks"].withColumn("embedding_model", F.lit("m"))}
    seen = []

    def judge(criterion, batch, attempt):
        seen.append((criterion, len(batch), attempt))
        return [{"id": c["id"], "verdict": "relevant" if "Метель" in c["text"] else "irrelevant", "reason": "r", "evidence": "метель выла"} for c in batch]

    tools = Tools(Search(tables, "k"), judge)
    with pytest.raises(ValueError):
        tools.show_selection()
    got = tools.search_fragments("storm", ["метель", "маша"])
    assert got["counts"]["relevant"] == 1 and got["counts"]["unreviewed"] == 0 and got["checked_now"] == sum(got["counts"].values()) and not got["budget_exhausted"]
    page = tools.show_selection("relevant")
    assert [p["marker"] for p in page] == ["F1"] and "Метель" in page[0]["model_text"]
    assert "Метель" in tools.read_around(page[0]["id"], 100)
    assert tools.filter_selection("storm at night")["checked_now"] == 1
    done = tools.set_fragment_status(page[0]["id"], "uncertain", "not sure")
    assert done["counts"]["uncertain"] == 1 and done["counts"]["relevant"] == 0
    with pytest.raises(ValueError):
        tools.set_fragment_status(page[0]["id"], "odd", "x")
    near = tools.related_fragments(page[0]["id"], 2)
    assert near and all(r["path"] for r in near)
    first = tools.read_section("c1", limit=20)
    assert first == {"text": TEXT[:20], "next_start": 20}
    assert [s["id"] for s in tools.get_scenes("c1")] == ["s1", "s2"]
    with pytest.raises(Exhausted):
        tools.show_selection()
    assert Tools(Search(tables, "k"), lambda *_: None).search_fragments("x", ["маша"])["budget_exhausted"]
    assert Tools(Search(tables, "k"), judge, judging.Limits(judge_calls=0)).search_fragments("x", ["маша"])["budget_exhausted"]


def test_entities_without_a_name(spark, book):  # noqa: F811
    s = Search(book, "k")
    assert [r.id for r in s.find_entities(types=["person"]).collect()] == ["m", "p"]
    with pytest.raises(ValueError):
        s.find_entities()


def test_links_are_rebuilt(spark):
    ev = "book_id string, id string, scene_id string, position int, roles array<double>, story array<double>, people array<string>, retold boolean"
    e = spark.createDataFrame([("k", "a", "1", 0, [1.0, 0.0], [1.0, 0.0], ["p"], False), ("k", "b", "2", 5, [0.0, 1.0], [0.0, 1.0], ["q"], False)], ev)
    links = spark.createDataFrame([("k", "2", "1", "causes", "r")], "book_id string, source_id string, target_id string, type string, reason string")
    reply = spark.createDataFrame([("a::b", 1, "causes", None, "right_to_left", "inferred", 0.5, "why")], "pair_id string, seq int, type string, subtype string, direction string, basis string, confidence double, reason string")
    pairs, decided, out = narrative.rebuilt(e, links, reply)
    assert rows(pairs, "left_id", "right_id", "required") == [("a", "b", True)] and rows(out, "book_id", "source_id", "target_id", "type") == [("k", "b", "a", "causes")]
    assert vectors.hashing_embedder(4)(["x"]) and decided.count() == 1
