"""Writes that keep what is computed about books consistent, as whole new tables.

Every function takes the tables it touches, in a dict of DataFrames by name, and a batch of new rows, which may concern
many books, chapters or scenes at once; it returns the dict with new frames in place of the changed ones. Nothing is collected
but guards. Store the results in a lectern.library.Library. Which rows name which is declared once, in NAMES; ``cascade`` follows it from the
keys that a write removes through all tables by anti joins, so the work is that of the rows removed. Null keys match nothing; repeated new
keys are the caller's fault. Tables that are absent are passed over.

Tables: books(book_id, text, text_hash, revision), sections(book_id, id, parent_id, start, level), blocks(book_id, id, section_id,
role, start_char, end_char), layers(book_id, chapter_id, status), scenes(book_id, chapter_id, id, start_char, end_char, text_hash),
chunks(book_id, chapter_id, scene_id, id, start_char, end_char, text), annotations(book_id, chunk_id), mentions(book_id, scene_id, id,
scene_text_hash, start_offset, end_offset), references(book_id, scene_id, id, target_mention_id), chapter_entities(book_id, chapter_id,
id, mention_ids), resolves(book_id, chapter_entity_id, book_entity_id, decision), book_entities(book_id, id), possibly_same(book_id,
left_id, right_id, score), entities(book_id, id), refers(book_id, mention_id, entity_id), events(book_id, scene_id, id),
event_links(book_id, source_id, target_id), scene_links(book_id, source_id, target_id), index_state(book_id, generation, text_hash).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import spans
from lectern.functions import text as T
from lectern.operators import intervals, structure
from lectern.operators.sessions import Conflict

Tables = dict[str, DataFrame]
SEARCHABLE = ("ready", "partial")
_BOOK = ("book_id", "books", "book_id")
#: What rows name: table -> (its column, table named, column there); every key goes with book_id, null names nothing. A table comes after
#: those it names, but for itself and for those in HELD. A row goes with any row that it names; arrays name all their items.
NAMES: dict[str, tuple[tuple[str, str, str], ...]] = {
    "sections": (_BOOK, ("parent_id", "sections", "id")),
    "blocks": (_BOOK, ("section_id", "sections", "id")),
    "layers": (_BOOK, ("chapter_id", "sections", "id")),
    "scenes": (_BOOK, ("chapter_id", "layers", "chapter_id")),
    "chunks": (_BOOK, ("scene_id", "scenes", "id")),
    "annotations": (_BOOK, ("chunk_id", "chunks", "id")),
    "mentions": (_BOOK, ("scene_id", "scenes", "id")),
    "references": (_BOOK, ("scene_id", "scenes", "id"), ("target_mention_id", "mentions", "id")),
    "chapter_entities": (_BOOK, ("chapter_id", "layers", "chapter_id"), ("mention_ids", "mentions", "id")),
    "resolves": (_BOOK, ("chapter_entity_id", "chapter_entities", "id"), ("book_entity_id", "book_entities", "id")),
    "book_entities": (_BOOK,),
    "possibly_same": (_BOOK, ("left_id", "book_entities", "id"), ("right_id", "book_entities", "id")),
    "entities": (_BOOK,),
    "refers": (_BOOK, ("mention_id", "mentions", "id"), ("entity_id", "entities", "id")),
    "events": (_BOOK, ("scene_id", "scenes", "id")),
    "event_links": (_BOOK, ("source_id", "events", "id"), ("target_id", "events", "id")),
    "scene_links": (_BOOK, ("source_id", "scenes", "id"), ("target_id", "scenes", "id")),
    "summary_embeddings": (_BOOK, ("id", "scenes", "id")),
    "postings": (_BOOK,),
    "posting_stats": (_BOOK,),
    "index_state": (_BOOK,),
}
#: Rows that go when the last row that names them goes: table -> (its column, table that names it, column there).
HELD = {"book_entities": ("id", "resolves", "book_entity_id")}


def without(rows: DataFrame, gone: DataFrame, on: dict[str, str]) -> DataFrame:
    """rows less those whose columns (keys of ``on``) are found in gone (values of ``on``)."""
    keys = gone.select(*[F.col(theirs).alias(mine) for mine, theirs in on.items()]).distinct()
    return rows.join(keys, list(on), "left_anti").select(*rows.columns)


def only(rows: DataFrame, kept: DataFrame, on: dict[str, str]) -> DataFrame:
    """rows whose columns (keys of ``on``) are found in kept (values of ``on``)."""
    keys = kept.select(*[F.col(theirs).alias(mine) for mine, theirs in on.items()]).distinct()
    return rows.join(keys, list(on), "left_semi").select(*rows.columns)


def replaced(old: DataFrame, new: DataFrame, scope: DataFrame, on: list[str]) -> DataFrame:
    """old with new in place of all rows in the scope; columns that new lacks are null."""
    return without(old, scope, {c: c for c in on}).unionByName(new, allowMissingColumns=True).select(*old.columns)


def _items(rows: DataFrame, column: str, named: DataFrame, key: str) -> DataFrame:
    """(book_id, id) of the rows of which an item of ``column`` is among the keys (book_id, key)."""
    items = rows.select("book_id", "id", F.explode(F.col(column).cast("array<string>")).alias("__item"))
    keys = named.select("book_id", F.col(key).cast("string").alias("__item"))
    return items.join(keys, ["book_id", "__item"], "left_semi").select("book_id", "id")


def _kept(keys: DataFrame) -> DataFrame:
    """keys, written once where the session has a folder for checkpoints: several tables are compared with them."""
    return keys.checkpoint() if keys.sparkSession.sparkContext.getCheckpointDir() else keys


def cascade(t: Tables, gone: Tables) -> Tables:
    """All tables less the rows that name, over any number of steps, a key that is gone; gone: table -> (book_id, key column).

    The rows of the gone keys themselves go too. Tables in HELD also lose the rows that nothing names any more, in books where a naming row
    went. Sections go with all below them. Frames of tables that can't lose anything are the same objects as before. Tables that no other
    names are compared with the keys once; of the others, the keys that go are found first and kept."""
    out, lost = dict(t), {}
    for name in ["books", *NAMES]:
        if name not in t:
            continue
        rows, refs = t[name], [r for r in NAMES.get(name, ()) if r[1] != name and r[0] in t[name].columns]
        kinds = dict(rows.dtypes)
        # of a table that comes later only what is gone from the start
        named = [(column, lost.get(to, gone.get(to)), key) for column, to, key in refs if to in lost or to in gone]
        first = gone.get(name)
        key = next((c for c in first.columns if c != "book_id"), "book_id") if first is not None else None
        held = name in HELD and HELD[name][1] in lost
        if first is None and not named and not held:
            continue
        asked = [k for other, those in NAMES.items() if other in t for _, to, k in those if to == name and k in rows.columns]
        up = next((column for column, to, _ in NAMES.get(name, ()) if to == name), None)
        if not asked and not up and name not in HELD and name not in [by for _, by, _ in HELD.values()] and not any(kinds[c].startswith("array") for c, _, _ in named):
            for column, keys, theirs in [*named, *([(key, first, key)] if key else [])]:
                both = {"book_id": "book_id", column: theirs}
                rows = rows.join(keys.select(*[F.col(b).alias(a) for a, b in both.items()]), list(both), "left_anti").select(*rows.columns)
            out[name] = rows
            continue
        on = ["book_id", "id"] if "id" in rows.columns else [c for c, kind in rows.dtypes if not kind.startswith(("array", "map"))]
        wanted = list(dict.fromkeys(["book_id", *on, *asked]))
        hits = []
        if key:
            own = first.where(F.col("book_id").isNotNull() & F.col(key).isNotNull())
            hits.append(own.select(*wanted) if {*wanted} == {"book_id", key} else only(rows, own, {"book_id": "book_id", key: key}).select(*wanted))
        for column, keys, theirs in sorted(named, key=lambda n: kinds[n[0]].startswith("array")):
            if kinds[column].startswith("array"):
                rest = rows  # of rows that go anyway no item is looked at
                for h in hits:
                    rest = without(rest, h, {c: c for c in on})
                hit = _items(rest, column, keys, theirs)
                hits.append(hit.select(*wanted) if {*wanted} == {"book_id", "id"} else only(rows, hit, {"book_id": "book_id", "id": "id"}).select(*wanted))
            else:
                hits.append(only(rows, keys, {"book_id": "book_id", column: theirs}).select(*wanted))
        if held:
            held_by, by, theirs = HELD[name]
            own = only(rows, lost[by], {"book_id": "book_id"})
            hits.append(without(own, out[by].where(F.col(theirs).isNotNull()), {"book_id": "book_id", held_by: theirs}).select(*wanted))
        void = hits[0]
        for h in hits[1:]:
            void = void.unionByName(h)
        if up:  # what lies below goes as well
            below = structure.closure(rows.select("book_id", "id", up), void.select("book_id", "id").distinct(), "id", up, by=("book_id",))
            void = only(rows, below, {"book_id": "book_id", "id": "id"}).select(*wanted)
        lost[name] = _kept(void.distinct())
        out[name] = _less(rows, lost[name], on)
    return out


def _less(rows: DataFrame, void: DataFrame, on: list[str]) -> DataFrame:
    """rows less those equal to one in void on some columns, null equal to null."""
    v = void.select(*[F.col(c).alias(f"__{c}") for c in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(v, same, "left_anti").select(*rows.columns)


def missing(t: Tables) -> DataFrame:
    """(name, column, book_id, key): every key that a row of a table names and that isn't there, once.

    All columns that name the same keys are gathered, a bit each, and compared with them once. Keys are compared as they are where their types
    agree, else as text."""
    kind_of = lambda name, column: dict(t[name].dtypes)[column]
    refs = [(name, column, to, key) for name, those in NAMES.items() for column, to, key in those if name in t and to in t and column in t[name].columns]
    out = None
    for to, key in dict.fromkeys(r[2:] for r in refs):
        naming = [(name, column) for name, column, *target in refs if target == [to, key]]
        books = {kind_of(n, "book_id") for n in [to, *[n for n, _ in naming]]}
        kinds = {kind_of(to, key), *[kind_of(n, c) for n, c in naming]}
        plain = lambda c, found: c if found in ({"bigint"}, {"int"}, {"string"}) else c.cast("string")
        by = ["book_id"] if key == "book_id" else ["book_id", "key"]
        named = None
        for i, (name, column) in enumerate(naming):
            listed = kind_of(name, column).startswith("array")
            each = F.explode(F.col(column).cast("array<string>")) if listed else plain(F.col(column), kinds)
            rows = t[name].select(plain(F.col("book_id"), books).alias("book_id"), *([each.alias("key")] if "key" in by else []), F.lit(1 << i).cast("long").alias("bit")).where(f"{by[-1]} is not null")
            named = rows if named is None else named.unionByName(rows)
        there = t[to].select(plain(F.col("book_id"), books).alias("book_id"), *([plain(F.col(key), kinds).alias("key")] if "key" in by else []))
        part = named.groupBy(*by).agg(F.bit_or("bit").alias("bits")).join(there, by, "left_anti")
        who = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.struct(F.lit(n).alias("name"), F.lit(c).alias("column"))) for i, (n, c) in enumerate(naming)]))
        part = part.select(F.explode(who).alias("who"), "book_id", F.col(by[-1]).alias("key")).select("who.name", "who.column", F.col("book_id").cast("string").alias("book_id"), F.col("key").cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def chain(rows: DataFrame, by: list[str], *order: str | Column) -> DataFrame:
    """Edges (by, id, next_id) between neighbours in an order."""
    following = F.lead("id").over(Window.partitionBy(*by).orderBy(*order))
    return rows.select(*by, "id", following.alias("next_id")).where("next_id is not null")


def sync_sections(t: Tables, books: DataFrame, sections: DataFrame) -> Tables:
    """Sections of the books(book_id) replaced; tree edges follow parent_id."""
    return t | {"sections": replaced(t["sections"], sections, books, ["book_id"])}


def tree_edges(sections: DataFrame) -> DataFrame:
    """(book_id, parent_id, id): the book holds its roots, a section those that name it as parent."""
    return sections.select("book_id", F.coalesce("parent_id", F.col("book_id").cast("string")).alias("parent_id"), "id")


def sync_blocks(t: Tables, books: DataFrame, blocks: DataFrame) -> Tables:
    """Blocks of the books(book_id) replaced."""
    return t | {"blocks": replaced(t["blocks"], blocks, books, ["book_id"])}


def next_blocks(blocks: DataFrame) -> DataFrame:
    """NEXT edges between the blocks of a section, by place."""
    return chain(blocks, ["book_id", "section_id"], "start_char", "end_char", "id")


def chunk_scenes(scenes: DataFrame, blocks: DataFrame, books: DataFrame, least: int = 400, most: int = 1200) -> DataFrame:
    """Chunks of the scenes(book_id, chapter_id, id, start_char, end_char): of what their chapter's body has without epigraphs and notes."""
    body = blocks.where("role = 'body'").select("book_id", F.col("section_id").alias("chapter_id"), "start_char", "end_char")
    holes = blocks.where(F.col("role").isin("epigraph", "footnotes")).select("book_id", F.col("section_id").alias("chapter_id"), "start_char", "end_char")
    ranges = intervals.subtract(body, holes, ["book_id", "chapter_id"]).select("book_id", "chapter_id", F.col("start_char").alias("a"), F.col("end_char").alias("b"))
    parts = scenes.join(ranges, ["book_id", "chapter_id"]).where("start_char < b and end_char > a")
    parts = parts.select("book_id", "chapter_id", F.col("id").alias("scene_id"), F.greatest("start_char", "a").alias("a"), F.least("end_char", "b").alias("b"))
    cut = parts.join(books.select("book_id", "text"), "book_id").withColumn("part", T.slice_of(F.col("text"), F.col("a"), F.col("b")))
    each = cut.select("book_id", "chapter_id", "scene_id", "a", "part", F.explode(spans.chunks(F.col("part"), least, most)).alias("c"))
    made = each.select("book_id", "chapter_id", "scene_id", (F.col("a") + F.col("c.start_char")).alias("start_char"), (F.col("a") + F.col("c.end_char")).alias("end_char"), F.substring("part", F.col("c.start_char") + 1, F.col("c.end_char") - F.col("c.start_char")).alias("text"))
    return made.withColumn("id", chunk_id(F.col("scene_id"), F.col("start_char"), F.col("end_char"), F.col("text")))


def chunk_id(scene: Column, start: Column, end: Column, text: Column) -> Column:
    """``scene:start:end:hash`` with the first 16 digits of the text's SHA-256; a chunk without a scene is unscoped."""
    return F.concat_ws(":", F.coalesce(scene.cast("string"), F.lit("unscoped")), start, end, F.substring(F.sha2(text, 256), 1, 16))


def changed_scenes(old: DataFrame, layers: DataFrame, new: DataFrame) -> DataFrame:
    """(book_id, chapter_id, scene_id) of old scenes in the layers' chapters that are gone, moved, rewritten or not ready any more."""
    now = new.select("book_id", "id", F.col("start_char").alias("s"), F.col("end_char").alias("e"), F.col("text_hash").alias("h"))
    both = old.join(layers.select("book_id", "chapter_id", "status"), ["book_id", "chapter_id"]).join(now, ["book_id", "id"], "left")
    same = F.col("start_char").eqNullSafe(F.col("s")) & F.col("end_char").eqNullSafe(F.col("e")) & F.col("text_hash").eqNullSafe(F.col("h"))
    return both.where((F.col("status") != "ready") | ~same).select("book_id", "chapter_id", F.col("id").alias("scene_id"))


def write_layers(t: Tables, layers: DataFrame, scenes: DataFrame) -> Tables:
    """Scene layers(book_id, chapter_id, status) written with all their scenes, and what depends on changed scenes removed.

    All that names a changed scene goes, and what names that: mentions, references, events, links of events and scenes, what mentions refer to; so
    do the chapter entities of their chapters, book entities that no chapter entity resolves to any more, and pairs of such. Chunks of the
    chapters are cut anew; annotations of chunks that are gone go. The books' index state is cleared."""
    scope = layers.select("book_id", "chapter_id").distinct()
    void = changed_scenes(t["scenes"], layers, scenes)
    chapters = {"book_id": "book_id", "chapter_id": "chapter_id"}
    lost = only(t["chapter_entities"], void, chapters)
    out = cascade(t, {"scenes": void.select("book_id", F.col("scene_id").alias("id")), "chapter_entities": lost.select("book_id", "id")})
    active = only(scenes, layers.where(F.col("status").isin(*SEARCHABLE)), chapters)
    cut = chunk_scenes(active, t["blocks"], t["books"])
    stale = without(only(t["chunks"], scope, chapters), cut, {"book_id": "book_id", "id": "id"})
    out = cascade(out, {"chunks": stale.select("book_id", "id")})
    out["layers"] = replaced(t["layers"], layers, scope, ["book_id", "chapter_id"])
    out["scenes"] = replaced(t["scenes"], scenes, scope, ["book_id", "chapter_id"])
    out["chunks"] = replaced(t["chunks"], cut, scope, ["book_id", "chapter_id"])
    out["index_state"] = without(t["index_state"], scope, {"book_id": "book_id"})
    return out


def delete_books(t: Tables, books: DataFrame) -> Tables:
    """All rows of the books(book_id) removed from every table."""
    return {name: without(rows, books, {"book_id": "book_id"}) for name, rows in t.items()}


def mentions_in_chunks(scenes: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(book_id, chunk_id, mention_id) where a chunk overlaps a mention of its scene."""
    placed = mentions.join(scenes.select("book_id", F.col("id").alias("scene_id"), F.col("start_char").alias("base")), ["book_id", "scene_id"])
    m = placed.select("book_id", "scene_id", F.col("id").alias("mention_id"), (F.col("base") + F.col("start_offset")).alias("a"), (F.col("base") + F.col("end_offset")).alias("b"))
    c = chunks.select("book_id", "scene_id", F.col("id").alias("chunk_id"), "start_char", "end_char")
    return c.join(m, ["book_id", "scene_id"]).where("start_char < b and end_char > a").select("book_id", "chunk_id", "mention_id")


def replace_mentions(t: Tables, sources: DataFrame, mentions: DataFrame, references: DataFrame) -> Tables:
    """Mentions and references of the scenes sources(book_id, chapter_id, scene_id, text_hash) replaced; their chapters' entities go.

    So does what names a mention that isn't among the new ones, and book entities that nothing resolves to any more.
    Conflict if a scene has another text by now or its layer isn't ready."""
    ready = t["scenes"].join(t["layers"].where("status = 'ready'").select("book_id", "chapter_id"), ["book_id", "chapter_id"], "left_semi")
    _unchanged(sources.select("book_id", F.col("scene_id").alias("id"), "text_hash"), ready.select("book_id", "id", "text_hash"), "a scene has changed")
    scope = ["book_id", "scene_id"]
    linked = only(references, mentions, {"book_id": "book_id", "scene_id": "scene_id", "target_mention_id": "id"})
    old = only(t["mentions"], sources, {c: c for c in scope})
    lost = only(t["chapter_entities"], sources, {"book_id": "book_id", "chapter_id": "chapter_id"})
    out = cascade(t, {"mentions": without(old, mentions, {"book_id": "book_id", "id": "id"}).select("book_id", "id"), "chapter_entities": lost.select("book_id", "id")})
    return out | {"mentions": replaced(t["mentions"], mentions, sources, scope), "references": replaced(out["references"], linked, sources, scope)}


def _unchanged(expected: DataFrame, actual: DataFrame, message: str) -> None:
    """Conflict unless all expected rows are among the actual ones, null equal to null; rows of other books are left out before any shuffle of keys."""
    near = actual.select(*expected.columns).join(expected.select("book_id").distinct(), "book_id", "left_semi")
    if _less(expected, near, expected.columns).head(1):
        raise Conflict(message)


def _same(expected: DataFrame, actual: DataFrame, message: str) -> None:
    """Conflict unless both have the same rows, null equal to null, however often; each is made and shuffled once."""
    cols = expected.columns
    side = lambda rows, n: rows.select(*cols, F.lit(n == 0).alias("__expected"), F.lit(n == 1).alias("__actual"))
    both = side(expected, 0).unionByName(side(actual, 1)).groupBy(*cols).agg(F.max("__expected").alias("__expected"), F.max("__actual").alias("__actual"))
    if both.where("not (__expected and __actual)").head(1):
        raise Conflict(message)


def replace_chapter_entities(t: Tables, chapters: DataFrame, sources: DataFrame, entities: DataFrame) -> Tables:
    """Entities of the chapters(book_id, chapter_id) replaced; sources(book_id, id, scene_text_hash) are all mentions they were made of.

    Conflict if the chapters' mentions are others by now. Book entities that nothing resolves to any more go."""
    scenes = only(t["scenes"], chapters, {"book_id": "book_id", "chapter_id": "chapter_id"})
    now = only(t["mentions"], scenes, {"book_id": "book_id", "scene_id": "id"}).select("book_id", "id", "scene_text_hash")
    _same(sources, now, "the mentions have changed")
    # a new entity of an old id is another one, so all that named the old ones goes
    old = only(t["chapter_entities"], chapters, {"book_id": "book_id", "chapter_id": "chapter_id"}).select("book_id", "id")
    out = cascade(t, {"chapter_entities": old})
    return out | {"chapter_entities": replaced(t["chapter_entities"], entities, chapters, ["book_id", "chapter_id"])}


def replace_resolution(t: Tables, books: DataFrame, sources: DataFrame, decisions: DataFrame, entities: DataFrame) -> Tables:
    """Book entities and resolutions of whole books replaced; sources(book_id, id, mention_ids) are all their chapter entities."""
    now = only(t["chapter_entities"], books, {"book_id": "book_id"}).select("book_id", "id", "mention_ids")
    _same(sources, now, "chapter entities have changed")
    known = F.col("book_entity_id").isNull()
    kept = decisions.where(known).unionByName(only(decisions.where(~known), entities, {"book_id": "book_id", "book_entity_id": "id"}))
    lost = without(only(t["book_entities"], books, {"book_id": "book_id"}), entities, {"book_id": "book_id", "id": "id"})
    out = cascade(t, {"book_entities": lost.select("book_id", "id")})
    return out | {"book_entities": replaced(t["book_entities"], entities, books, ["book_id"]), "resolves": replaced(t["resolves"], kept, books, ["book_id"])}


def apply_resolution(t: Tables, sources: DataFrame, decisions: DataFrame, entities: DataFrame) -> Tables:
    """A batch of decisions(book_id, chapter_entity_id, book_entity_id, decision) on chapter entities applied; entities are upserted."""
    _unchanged(sources, t["chapter_entities"].select("book_id", "id", "mention_ids"), "a chapter entity has changed")
    after = replaced(t["book_entities"], entities, entities, ["book_id", "id"])
    named = decisions.where("book_entity_id is not null").select("book_id", F.col("book_entity_id").alias("id"))
    _unchanged(named.distinct(), after.select("book_id", "id"), "no such book entity")
    return t | {"book_entities": after, "resolves": replaced(t["resolves"], decisions, decisions, ["book_id", "chapter_entity_id"])}


def merge_entities(t: Tables, merges: DataFrame, merged: DataFrame) -> Tables:
    """Book entities merged: merges(book_id, loser_id, survivor_id) repoint resolutions, merged rows replace the survivors; pairs with a loser go."""
    m = merges.select("book_id", F.col("loser_id").alias("book_entity_id"), F.col("survivor_id").alias("__to"))
    moved = t["resolves"].join(m, ["book_id", "book_entity_id"], "left").withColumn("book_entity_id", F.coalesce("__to", "book_entity_id"))
    after = t | {"resolves": moved.select(*t["resolves"].columns).distinct(), "book_entities": replaced(t["book_entities"], merged, merged, ["book_id", "id"])}
    return cascade(after, {"book_entities": merges.select("book_id", F.col("loser_id").alias("id"))})


def write_possibly_same(t: Tables, books: DataFrame, pairs: DataFrame) -> Tables:
    """Pairs(book_id, left_id, right_id, score) of the books replaced: in canonical order, once, and only where both ends exist."""
    ends = pairs.select("book_id", F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "score").where("left_id < right_id")
    one = ends.groupBy("book_id", "left_id", "right_id").agg(F.max("score").alias("score"))
    for end in ("left_id", "right_id"):
        one = only(one, t["book_entities"], {"book_id": "book_id", end: "id"})
    return t | {"possibly_same": replaced(t["possibly_same"], one, books, ["book_id"])}


def apply_flat(t: Tables, resolutions: DataFrame, entities: DataFrame) -> Tables:
    """Mentions linked to entities: resolutions(book_id, mention_id, entity_id) replace what a mention refers to; null unlinks it."""
    after = replaced(t["entities"], entities, entities, ["book_id", "id"])
    _unchanged(resolutions.select("book_id", F.col("mention_id").alias("id")).distinct(), t["mentions"].select("book_id", "id"), "no such mention")
    linked = resolutions.where("entity_id is not null")
    _unchanged(linked.select("book_id", F.col("entity_id").alias("id")).distinct(), after.select("book_id", "id"), "no such entity")
    return t | {"entities": after, "refers": replaced(t["refers"], linked, resolutions, ["book_id", "mention_id"])}


def replace_annotations(t: Tables, sources: DataFrame, annotations: DataFrame, events: DataFrame) -> Tables:
    """Chunk annotations and events of the scenes sources(book_id, scene_id, text_hash) replaced; links of the old events go. Conflict if a text has changed."""
    _unchanged(sources.select("book_id", F.col("scene_id").alias("id"), "text_hash"), t["scenes"].select("book_id", "id", "text_hash"), "a scene has changed")
    chunks = only(t["chunks"], sources, {"book_id": "book_id", "scene_id": "scene_id"}).select("book_id", F.col("id").alias("chunk_id"))
    out = cascade(t, {"events": only(t["events"], sources, {"book_id": "book_id", "scene_id": "scene_id"}).select("book_id", "id")})
    return out | {"annotations": replaced(t["annotations"], only(annotations, t["chunks"], {"book_id": "book_id", "chunk_id": "id"}), chunks, ["book_id", "chunk_id"]), "events": replaced(t["events"], events, sources, ["book_id", "scene_id"])}


def replace_event_links(t: Tables, books: DataFrame, links: DataFrame) -> Tables:
    """Links between events of the books replaced; links without both events are left out."""
    for end in ("source_id", "target_id"):
        links = only(links, t["events"], {"book_id": "book_id", end: "id"})
    return t | {"event_links": replaced(t["event_links"], links, books, ["book_id"])}


def replace_scene_links(t: Tables, books: DataFrame, links: DataFrame) -> Tables:
    """Links between scenes of the books replaced; Conflict if the text of either end isn't that of its source_hash or target_hash."""
    for end, digest in (("source_id", "source_hash"), ("target_id", "target_hash")):
        _unchanged(links.select("book_id", F.col(end).alias("id"), F.col(digest).alias("text_hash")).distinct(), t["scenes"].select("book_id", "id", "text_hash"), "a scene has changed")
    return t | {"scene_links": replaced(t["scene_links"], links, books, ["book_id"])}


def replace_index(t: Tables, source: DataFrame, chunks: DataFrame, summaries: DataFrame, model: str) -> tuple[Tables, str]:
    """(tables, generation): chunks and summary vectors of the books source(book_id, revision, text_hash, generation) replaced.

    Conflict if revision, text or generation of a book are others by now. The state counts chunks, scenes and their vectors."""
    state = t["index_state"].select("book_id", "generation")
    now = t["books"].join(state, "book_id", "left").select("book_id", "revision", "text_hash", "generation")
    _unchanged(source, now, "the book or its index has changed")
    generation = uuid.uuid4().hex
    count = lambda rows, n, k: rows.groupBy("book_id").agg(F.count("*").alias(n), F.count("embedding").alias(k), F.max(F.size("embedding")).alias(f"{n}_dims"))
    counted = source.select("book_id", "text_hash").join(count(chunks, "n_chunks", "n_embedded"), "book_id", "left").join(count(summaries, "n_scenes", "n_scenes_embedded"), "book_id", "left")
    fresh = counted.select("book_id", F.lit(generation).alias("generation"), "text_hash", F.lit(model).alias("model"), F.greatest("n_chunks_dims", "n_scenes_dims").alias("dims"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_embedded", "n_scenes", "n_scenes_embedded")])
    again = lambda name, rows: without(t[name], source, {"book_id": "book_id"}).unionByName(rows, allowMissingColumns=True)
    out = {"chunks": again("chunks", chunks), "index_state": again("index_state", fresh)}
    if "summary_embeddings" in t:
        out["summary_embeddings"] = again("summary_embeddings", summaries.where("embedding is not null").select(*[c for c in summaries.columns if c in t["summary_embeddings"].columns]))
    elif "embedding" in summaries.columns:
        out["summary_embeddings"] = summaries.where("embedding is not null")
    return t | out, generation


def migrate_elements(t: Tables, elements: DataFrame) -> Tables:
    """Coordinates from stored elements(book_id, pos, text): sections given by positions get start_char and end_char."""
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("book_id").orderBy("pos")) - F.length("text") - 1
    at = elements.select("book_id", "pos", before.alias("char"), (before + F.length("text")).alias("until"))
    first = at.select("book_id", F.col("pos").alias("start"), F.col("char").alias("start_char"))
    last = at.select("book_id", (F.col("pos") + 1).alias("end"), F.col("until").alias("end_char"))
    kept = t["sections"].drop("start_char", "end_char")
    return t | {"sections": kept.join(first, ["book_id", "start"], "left").join(last, ["book_id", "end"], "left")}
