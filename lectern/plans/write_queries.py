"""Queries over the writes: orders as scenes of customers' books, line items as mentions, priorities as chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import writes
from lectern.plans.registry import query, table

_LIB = """scenes AS (SELECT o_custkey AS book_id, o_orderpriority AS chapter_id, o_orderkey AS id, o_orderkey * 1000 AS start_char, o_orderkey * 1000 + 900 AS end_char, o_orderkey * 7 % 1000 AS text_hash FROM orders),
mentions AS (SELECT s.book_id, s.id AS scene_id, s.id * 10 + l_linenumber AS id, s.text_hash AS scene_text_hash, l_linenumber * 100 AS start_offset, l_linenumber * 100 + 60 AS end_offset FROM lineitem JOIN scenes s ON s.id = l_orderkey),
chapter_entities AS (SELECT DISTINCT book_id, chapter_id, book_id || ':' || chapter_id AS id FROM scenes),
resolves AS (SELECT book_id, id AS chapter_entity_id, CASE WHEN chapter_id < '3' THEN book_id * 10 + 1 ELSE book_id * 10 + 2 END AS book_entity_id FROM chapter_entities),
book_entities AS (SELECT DISTINCT book_id, book_entity_id AS id FROM resolves)"""


def library(spark, sf_dir) -> writes.Tables:
    """All tables of the writes for the orders; one reference, event, chunk and link to the next scene for each scene or mention."""
    o = table(spark, sf_dir, "orders")
    scenes = o.select(F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("chapter_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 1000).alias("start_char"), (F.col("o_orderkey") * 1000 + 900).alias("end_char"), (F.col("o_orderkey") * 7 % 1000).alias("text_hash"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").cast("long").alias("n"))
    own = scenes.select("book_id", F.col("id").alias("scene_id"), F.col("text_hash").alias("scene_text_hash"))
    mentions = own.join(l, "scene_id").select("book_id", "scene_id", (F.col("scene_id") * 10 + F.col("n")).alias("id"), "scene_text_hash", (F.col("n") * 100).alias("start_offset"), (F.col("n") * 100 + 60).alias("end_offset"))
    chapters = scenes.select("book_id", "chapter_id").distinct()
    entities = chapters.select("book_id", "chapter_id", F.concat_ws(":", "book_id", "chapter_id").alias("id"))
    resolves = entities.select("book_id", F.col("id").alias("chapter_entity_id"), (F.col("book_id") * 10 + F.when(F.col("chapter_id") < "3", 1).otherwise(2)).alias("book_entity_id"), F.lit("same").alias("decision"))
    chunks = scenes.select("book_id", "chapter_id", F.col("id").alias("scene_id"), F.col("id").cast("string").alias("id"), "start_char", "end_char", F.lit("").alias("text"))
    return {
        "books": scenes.select("book_id").distinct().select("book_id", F.lit("").alias("text"), (F.col("book_id") % 9).alias("text_hash"), F.lit(1).alias("revision")),
        "sections": chapters.select("book_id", F.col("chapter_id").alias("id"), F.lit(None).cast("string").alias("parent_id")),
        "blocks": chapters.select("book_id", F.col("chapter_id").alias("section_id"), F.concat_ws(":", "book_id", "chapter_id").alias("id"), F.lit("body").alias("role"), F.lit(0).cast("long").alias("start_char"), F.lit(1 << 40).cast("long").alias("end_char")),
        "layers": chapters.withColumn("status", F.lit("ready")),
        "scenes": scenes, "mentions": mentions, "chapter_entities": entities, "resolves": resolves, "chunks": chunks,
        "references": mentions.select("book_id", "scene_id", F.col("id"), F.col("id").alias("target_mention_id")),
        "annotations": chunks.select("book_id", F.col("id").alias("chunk_id")),
        "book_entities": resolves.select("book_id", F.col("book_entity_id").alias("id")).distinct(),
        "events": own.select("book_id", "scene_id", F.col("scene_id").alias("id")),
        "scene_links": own.select("book_id", F.col("scene_id").alias("source_id"), (F.col("scene_id") + 1).alias("target_id")),
        "event_links": own.select("book_id", F.col("scene_id").alias("source_id"), (F.col("scene_id") + 1).alias("target_id")),
        "possibly_same": spark.createDataFrame([], "book_id long, left_id long, right_id long, score double"),
        "entities": spark.createDataFrame([], "book_id long, id long"), "refers": spark.createDataFrame([], "book_id long, mention_id long, entity_id long"),
        "index_state": scenes.select("book_id").distinct().select("book_id", F.lit("g1").alias("generation"), (F.col("book_id") % 9).alias("text_hash")),
    }


def named(t: writes.Tables, *columns: tuple[str, str]):
    """(name, id) of the rows of several tables."""
    out = None
    for name, column in columns:
        part = t[name].select(F.lit(name).alias("name"), F.col(column).cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def rewritten(t: writes.Tables):
    """(layers, scenes): every third book's chapters written again; some partial, some scenes gone or rewritten."""
    some = F.col("book_id") % 3 == 0
    layers = t["layers"].where(some).withColumn("status", F.when(F.col("book_id") % 2 == 0, "partial").otherwise("ready"))
    scenes = t["scenes"].where(some & (F.col("id") % 5 != 0)).withColumn("text_hash", F.when(F.col("id") % 7 == 0, F.lit(-1)).otherwise(F.col("text_hash")).cast("long"))
    return layers, scenes


_VOID = "void AS (SELECT book_id, chapter_id, id FROM scenes WHERE book_id % 3 = 0 AND (book_id % 2 = 0 OR id % 5 = 0 OR id % 7 = 0))"


@query(f"""WITH {_LIB}, {_VOID},
ce AS (SELECT * FROM chapter_entities c WHERE NOT EXISTS (SELECT 1 FROM void v WHERE v.book_id = c.book_id AND v.chapter_id = c.chapter_id)),
rs AS (SELECT * FROM resolves WHERE chapter_entity_id IN (SELECT id FROM ce))
SELECT 'mentions' AS name, CAST(id AS VARCHAR) AS id FROM mentions WHERE scene_id NOT IN (SELECT id FROM void)
UNION ALL SELECT 'references', CAST(id AS VARCHAR) FROM mentions WHERE scene_id NOT IN (SELECT id FROM void)
UNION ALL SELECT 'events', CAST(id AS VARCHAR) FROM scenes WHERE id NOT IN (SELECT id FROM void)
UNION ALL SELECT 'annotations', CAST(id AS VARCHAR) FROM scenes WHERE book_id % 3 <> 0
UNION ALL SELECT 'scene_links', CAST(s.id AS VARCHAR) FROM scenes s WHERE NOT EXISTS (SELECT 1 FROM void v WHERE v.book_id = s.book_id AND v.id IN (s.id, s.id + 1))
UNION ALL SELECT 'chapter_entities', id FROM ce
UNION ALL SELECT 'resolves', chapter_entity_id FROM rs
UNION ALL SELECT 'book_entities', CAST(id AS VARCHAR) FROM book_entities b WHERE id IN (SELECT book_entity_id FROM rs) OR book_id NOT IN (SELECT book_id FROM void)
UNION ALL SELECT 'scenes', CAST(id AS VARCHAR) FROM scenes WHERE NOT (book_id % 3 = 0 AND id % 5 = 0)
UNION ALL SELECT 'index_state', CAST(book_id AS VARCHAR) FROM (SELECT DISTINCT book_id FROM scenes WHERE book_id % 3 <> 0)""")
def q_layer_cascade(spark, sf_dir):
    """What is left of all tables after every third book's scene layers are written again; without text no chunk is cut, so their annotations go."""
    t = library(spark, sf_dir)
    out = writes.write_layers(t, *rewritten(t))
    return named(out, ("mentions", "id"), ("references", "id"), ("events", "id"), ("annotations", "chunk_id"), ("scene_links", "source_id"), ("chapter_entities", "id"), ("resolves", "chapter_entity_id"), ("book_entities", "id"), ("scenes", "id"), ("index_state", "book_id"))


@query("""WITH lines AS (SELECT doc_id, length(text) AS n, text FROM documents WHERE length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) > 0 AND length(text) <= 150 AND NOT contains(text, chr(10)) AND text = trim(text)),
cut AS (SELECT doc_id, unnest([[0, least(60, n)], [60, n]]) AS r, text, n FROM lines)
SELECT doc_id AS book_id, CASE WHEN r[1] = 0 THEN 'a' ELSE 'b' END AS scene_id, CAST(r[1] + length(t) - length(ltrim(t)) AS BIGINT) AS start_char, CAST(r[2] - length(t) + length(rtrim(t)) AS BIGINT) AS end_char,
(CASE WHEN r[1] = 0 THEN 'a' ELSE 'b' END) || ':' || (r[1] + length(t) - length(ltrim(t))) || ':' || (r[2] - length(t) + length(rtrim(t))) || ':' || substr(sha256(trim(t)), 1, 16) AS id
FROM (SELECT *, substr(text, r[1] + 1, r[2] - r[1]) AS t FROM cut WHERE r[1] < r[2]) WHERE trim(t) <> ''""")
def q_scene_chunks(spark, sf_dir):
    """Chunks of two scenes of each short document of one line: one chunk a scene, with its id."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "text")
    short = d.where((F.length(F.trim("text")) > 0) & (F.length("text") <= 150) & ~F.contains("text", F.lit("\n")) & (F.col("text") == F.trim("text")))
    n = F.length("text").cast("long")
    blocks = short.select("book_id", F.lit("c").alias("section_id"), F.lit("body").alias("role"), F.lit(0).cast("long").alias("start_char"), n.alias("end_char"))
    a = short.select("book_id", F.lit("c").alias("chapter_id"), F.lit("a").alias("id"), F.lit(0).cast("long").alias("start_char"), F.least(F.lit(60), n).cast("long").alias("end_char"))
    b = short.select("book_id", F.lit("c").alias("chapter_id"), F.lit("b").alias("id"), F.lit(60).cast("long").alias("start_char"), n.alias("end_char")).where("start_char < end_char")
    return writes.chunk_scenes(a.union(b), blocks, short).select("book_id", "scene_id", "start_char", "end_char", "id")


@query("""WITH old AS (SELECT c_nationkey AS book_id, 'c' || c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN 'c' || (c_custkey // 4 * 4) END AS parent_id FROM customer)
SELECT CAST(book_id AS BIGINT) AS book_id, coalesce(parent_id, CAST(book_id AS VARCHAR)) AS parent_id, id FROM old WHERE book_id % 2 = 1
UNION ALL SELECT DISTINCT CAST(book_id AS BIGINT), CAST(book_id AS VARCHAR), 'new' FROM old WHERE book_id % 2 = 0""")
def q_section_sync(spark, sf_dir):
    """Tree edges after the sections of every second nation's book are replaced by one."""
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_nationkey").cast("long").alias("book_id"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 4) * 4)).alias("parent_id"))
    books = old.where("book_id % 2 = 0").select("book_id").distinct()
    out = writes.sync_sections({"sections": old}, books, books.select("book_id", F.lit("new").alias("id"), F.lit(None).cast("string").alias("parent_id")))
    return writes.tree_edges(out["sections"])


@query("""WITH b AS (SELECT CAST(c_nationkey AS BIGINT) AS book_id, c_mktsegment AS section_id, c_custkey AS id, CAST(c_acctbal AS BIGINT) AS start_char FROM customer)
SELECT * FROM (SELECT book_id, section_id, id, lead(id) OVER (PARTITION BY book_id, section_id ORDER BY start_char, id) AS next_id FROM b) WHERE next_id IS NOT NULL""")
def q_next_blocks(spark, sf_dir):
    """Blocks of a section in the order of their places, chained."""
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("book_id"), F.col("c_mktsegment").alias("section_id"), F.col("c_custkey").alias("id"), F.rint("c_acctbal").cast("long").alias("start_char"))
    b = b.withColumn("end_char", F.col("start_char") + 1)
    return writes.next_blocks(b)


@query(f"""WITH {_LIB}, k AS (SELECT book_id, id AS scene_id, id || ':' || i AS chunk_id, start_char + 150 * i AS a, start_char + 150 * i + 150 AS b FROM scenes, (SELECT unnest(range(6)) AS i))
SELECT m.book_id, chunk_id, m.id AS mention_id FROM mentions m JOIN k ON k.book_id = m.book_id AND k.scene_id = m.scene_id JOIN scenes s ON s.id = m.scene_id WHERE a < s.start_char + end_offset AND b > s.start_char + start_offset""")
def q_mentions_in_chunks(spark, sf_dir):
    """Mentions of a scene in those of its six chunks that they overlap."""
    t = library(spark, sf_dir)
    k = t["scenes"].select("book_id", F.col("id").alias("scene_id"), "start_char", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    k = k.select("book_id", "scene_id", F.concat_ws(":", "scene_id", "i").alias("id"), (F.col("start_char") + 150 * F.col("i")).alias("start_char"), (F.col("start_char") + 150 * F.col("i") + 150).alias("end_char"))
    return writes.mentions_in_chunks(t["scenes"], k, t["mentions"])


@query(f"""WITH {_LIB}, src AS (SELECT * FROM scenes WHERE id % 4 = 0)
SELECT 'mentions' AS name, CAST(id AS VARCHAR) AS id FROM mentions WHERE scene_id % 4 <> 0 UNION ALL SELECT 'mentions', CAST(-id AS VARCHAR) FROM src
UNION ALL SELECT 'references', CAST(id AS VARCHAR) FROM mentions WHERE scene_id % 4 <> 0 UNION ALL SELECT 'references', CAST(-id AS VARCHAR) FROM src WHERE id % 8 = 0
UNION ALL SELECT 'chapter_entities', id FROM chapter_entities c WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.book_id = c.book_id AND src.chapter_id = c.chapter_id)""")
def q_replace_mentions(spark, sf_dir):
    """Every fourth scene gets one new mention; half of the new references have no target and are left out."""
    t = library(spark, sf_dir)
    src = t["scenes"].where("id % 4 = 0").select("book_id", "chapter_id", F.col("id").alias("scene_id"), "text_hash")
    new = src.select("book_id", "scene_id", (-F.col("scene_id")).alias("id"), F.col("text_hash").alias("scene_text_hash"), F.lit(0).cast("long").alias("start_offset"), F.lit(5).cast("long").alias("end_offset"))
    refs = src.select("book_id", "scene_id", (-F.col("scene_id")).alias("id"), F.when(F.col("scene_id") % 8 == 0, -F.col("scene_id")).otherwise(0).alias("target_mention_id"))
    return named(writes.replace_mentions(t, src, new, refs), ("mentions", "id"), ("references", "id"), ("chapter_entities", "id"))


@query(f"""WITH {_LIB}, ch AS (SELECT DISTINCT book_id, chapter_id FROM scenes WHERE book_id % 4 = 0 AND chapter_id < '3'),
ce AS (SELECT * FROM chapter_entities c WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.book_id = c.book_id AND ch.chapter_id = c.chapter_id)),
rs AS (SELECT * FROM resolves WHERE chapter_entity_id IN (SELECT id FROM ce))
SELECT 'chapter_entities' AS name, id FROM ce UNION ALL SELECT 'chapter_entities', 'n' || book_id || ':' || chapter_id FROM ch
UNION ALL SELECT 'resolves', chapter_entity_id FROM rs
UNION ALL SELECT 'book_entities', CAST(id AS VARCHAR) FROM book_entities WHERE id IN (SELECT book_entity_id FROM rs) OR book_id NOT IN (SELECT book_id FROM ch)""")
def q_replace_chapter_entities(spark, sf_dir):
    """Entities of two chapters of every fourth book replaced; book entities without a source go."""
    t = library(spark, sf_dir)
    ch = t["layers"].where("book_id % 4 = 0 and chapter_id < '3'").select("book_id", "chapter_id")
    own = t["mentions"].join(t["scenes"].join(ch, ["book_id", "chapter_id"]).select("book_id", F.col("id").alias("scene_id")), ["book_id", "scene_id"], "left_semi")
    new = ch.select("book_id", "chapter_id", F.concat(F.lit("n"), F.concat_ws(":", "book_id", "chapter_id")).alias("id"))
    return named(writes.replace_chapter_entities(t, ch, own.select("book_id", "id", "scene_text_hash"), new), ("chapter_entities", "id"), ("resolves", "chapter_entity_id"), ("book_entities", "id"))


def with_mentions(t):
    """Tables whose chapter entities list a mention."""
    return t | {"chapter_entities": t["chapter_entities"].withColumn("mention_ids", F.array(F.col("id")))}


@query(f"""WITH {_LIB} SELECT 'resolves' AS name, chapter_entity_id || ':' || book_entity_id AS id FROM resolves WHERE book_id % 5 <> 0
UNION ALL SELECT 'resolves', id || ':' || (book_id * 100) FROM chapter_entities WHERE book_id % 5 = 0 AND chapter_id < '3' UNION ALL SELECT 'resolves', id || ':' FROM chapter_entities WHERE book_id % 5 = 0 AND chapter_id >= '4'
UNION ALL SELECT 'book_entities', CAST(id AS VARCHAR) FROM book_entities WHERE book_id % 5 <> 0 UNION ALL SELECT DISTINCT 'book_entities', CAST(book_id * 100 AS VARCHAR) FROM scenes WHERE book_id % 5 = 0""")
def q_replace_resolution(spark, sf_dir):
    """The resolution of every fifth book replaced: one entity, uncertain rest, a decision on an unknown entity left out."""
    t = with_mentions(library(spark, sf_dir))
    mine = t["chapter_entities"].where("book_id % 5 = 0")
    books = mine.select("book_id").distinct()
    to = F.when(F.col("chapter_id") < "3", F.col("book_id") * 100).when(F.col("chapter_id") < "4", F.lit(-1))
    decisions = mine.select("book_id", F.col("id").alias("chapter_entity_id"), to.cast("long").alias("book_entity_id"), F.lit("x").alias("decision"))
    out = writes.replace_resolution(t, books, mine.select("book_id", "id", "mention_ids"), decisions, books.select("book_id", (F.col("book_id") * 100).alias("id")))
    out["resolves"] = out["resolves"].withColumn("k", F.concat("chapter_entity_id", F.lit(":"), F.coalesce(F.col("book_entity_id").cast("string"), F.lit(""))))
    return named(out, ("resolves", "k"), ("book_entities", "id"))


@query(f"""WITH {_LIB} SELECT 'resolves' AS name, chapter_entity_id || ':' || (CASE WHEN book_id % 6 = 0 AND split_part(chapter_entity_id, ':', 2) < '2' THEN book_id * 10 + 7 ELSE book_entity_id END) AS id FROM resolves
UNION ALL SELECT 'book_entities', CAST(id AS VARCHAR) FROM book_entities UNION ALL SELECT DISTINCT 'book_entities', CAST(book_id * 10 + 7 AS VARCHAR) FROM scenes WHERE book_id % 6 = 0 AND chapter_id < '2'""")
def q_apply_resolution(spark, sf_dir):
    """A batch of decisions on one chapter of every sixth book, with a new entity each."""
    t = with_mentions(library(spark, sf_dir))
    mine = t["chapter_entities"].where("book_id % 6 = 0 and chapter_id < '2'")
    decisions = mine.select("book_id", F.col("id").alias("chapter_entity_id"), (F.col("book_id") * 10 + 7).alias("book_entity_id"), F.lit("new").alias("decision"))
    out = writes.apply_resolution(t, mine.select("book_id", "id", "mention_ids"), decisions, mine.select("book_id", (F.col("book_id") * 10 + 7).alias("id")).distinct())
    out["resolves"] = out["resolves"].withColumn("k", F.concat_ws(":", "chapter_entity_id", "book_entity_id"))
    return named(out, ("resolves", "k"), ("book_entities", "id"))


@query(f"""WITH {_LIB} SELECT 'resolves' AS name, chapter_entity_id || ':' || (CASE WHEN book_id % 2 = 0 THEN book_id * 10 + 1 ELSE book_entity_id END) AS id FROM resolves
UNION ALL SELECT 'book_entities', CAST(id AS VARCHAR) FROM book_entities WHERE NOT (book_id % 2 = 0 AND id % 10 = 2) UNION ALL SELECT 'book_entities', CAST(book_id * 10 + 1 AS VARCHAR) FROM book_entities b WHERE book_id % 2 = 0 AND id % 10 = 2 AND NOT EXISTS (SELECT 1 FROM book_entities c WHERE c.id = b.book_id * 10 + 1)""")
def q_merge_entities(spark, sf_dir):
    """The second entity of every second book merged into the first."""
    t = library(spark, sf_dir)
    losers = t["book_entities"].where("book_id % 2 = 0 and id % 10 = 2")
    merges = losers.select("book_id", F.col("id").alias("loser_id"), (F.col("book_id") * 10 + 1).alias("survivor_id"))
    out = writes.merge_entities(t, merges, merges.select("book_id", F.col("survivor_id").alias("id")))
    out["resolves"] = out["resolves"].withColumn("k", F.concat_ws(":", "chapter_entity_id", "book_entity_id"))
    return named(out, ("resolves", "k"), ("book_entities", "id"))


@query(f"""WITH {_LIB} SELECT a.book_id, a.id AS left_id, b.id AS right_id, round(a.book_id % 100 / 100.0, 6) AS score FROM book_entities a JOIN book_entities b ON a.book_id = b.book_id AND a.id < b.id""")
def q_possibly_same(spark, sf_dir):
    """The two entities of a book as a pair, given both ways round and with a pair that has an unknown end."""
    t = library(spark, sf_dir)
    books = t["books"].select("book_id")
    score = F.col("book_id") % 100 / 100
    pair = lambda a, b: books.select("book_id", (F.col("book_id") * 10 + a).alias("left_id"), (F.col("book_id") * 10 + b).alias("right_id"), score.alias("score"))
    out = writes.write_possibly_same(t, books, pair(1, 2).union(pair(2, 1)).union(pair(1, 9)))
    return out["possibly_same"].select("book_id", "left_id", "right_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_LIB} SELECT book_id, id AS mention_id, scene_id % 10 AS entity_id FROM mentions WHERE id % 3 = 1""")
def q_apply_flat(spark, sf_dir):
    """Mentions linked to entities; then every third is linked anew to the same and another third unlinked."""
    t = library(spark, sf_dir)
    entities = t["mentions"].select("book_id", (F.col("scene_id") % 10).alias("id")).distinct()
    links = t["mentions"].where("id % 3 <> 0").select("book_id", F.col("id").alias("mention_id"), (F.col("scene_id") % 10).alias("entity_id"))
    first = writes.apply_flat(t, links, entities)
    off = t["mentions"].where("id % 3 = 2").select("book_id", F.col("id").alias("mention_id"), F.lit(None).cast("long").alias("entity_id"))
    return writes.apply_flat(first, off, entities.limit(0))["refers"]


@query(f"""WITH {_LIB} SELECT 'annotations' AS name, CAST(id AS VARCHAR) AS id FROM scenes WHERE id % 6 <> 0 UNION ALL SELECT 'annotations', CAST(id AS VARCHAR) FROM scenes WHERE id % 12 = 0
UNION ALL SELECT 'events', CAST(id AS VARCHAR) FROM scenes WHERE id % 6 <> 0 UNION ALL SELECT 'events', CAST(-id AS VARCHAR) FROM scenes WHERE id % 6 = 0""")
def q_replace_annotations(spark, sf_dir):
    """Annotations and events of every sixth scene replaced."""
    t = library(spark, sf_dir)
    src = t["scenes"].where("id % 6 = 0").select("book_id", F.col("id").alias("scene_id"), "text_hash")
    notes = src.where("scene_id % 12 = 0").select("book_id", F.col("scene_id").cast("string").alias("chunk_id"))
    out = writes.replace_annotations(t, src, notes, src.select("book_id", "scene_id", (-F.col("scene_id")).alias("id")))
    return named(out, ("annotations", "chunk_id"), ("events", "id"))


@query(f"""WITH {_LIB}, new AS (SELECT a.book_id, a.id AS source_id, b.id AS target_id FROM scenes a JOIN scenes b ON a.book_id = b.book_id AND b.id = a.id + 3 WHERE a.book_id % 2 = 0)
SELECT 'event' AS kind, book_id, id AS source_id, id + 1 AS target_id FROM scenes WHERE book_id % 2 = 1 UNION ALL SELECT 'event', * FROM new
UNION ALL SELECT 'scene', book_id, id, id + 1 FROM scenes WHERE book_id % 2 = 1 UNION ALL SELECT 'scene', * FROM new""")
def q_replace_links(spark, sf_dir):
    """Links of every second book replaced, between events and between scenes; links to no event are left out."""
    t = library(spark, sf_dir)
    books = t["books"].where("book_id % 2 = 0").select("book_id")
    asked = t["scenes"].where("book_id % 2 = 0").select("book_id", F.col("id").alias("source_id"), (F.col("id") + 3).alias("target_id"), F.col("text_hash").alias("source_hash"))
    events = writes.replace_event_links(t, books, asked.drop("source_hash"))["event_links"]
    ends = t["scenes"].select("book_id", F.col("id").alias("target_id"), F.col("text_hash").alias("target_hash"))
    scenes = writes.replace_scene_links(t, books, asked.join(ends, ["book_id", "target_id"]))["scene_links"]
    return events.select(F.lit("event").alias("kind"), "book_id", "source_id", "target_id").union(scenes.select(F.lit("scene"), "book_id", "source_id", "target_id"))


@query(f"""WITH {_LIB}, n AS (SELECT book_id, count(*) AS n, count(CASE WHEN id % 3 = 0 THEN 1 END) AS e FROM scenes GROUP BY 1)
SELECT book_id, book_id % 2 = 0 AS renewed, CASE WHEN book_id % 2 = 0 THEN n END AS n_chunks, CASE WHEN book_id % 2 = 0 THEN e END AS n_embedded, CAST(CASE WHEN book_id % 2 = 0 THEN 0 END AS BIGINT) AS n_scenes, CAST(CASE WHEN book_id % 2 = 0 AND e > 0 THEN 2 END AS INTEGER) AS dims FROM n""")
def q_replace_index(spark, sf_dir):
    """The index state after every second book's chunks are replaced, a third of them with vectors."""
    t = library(spark, sf_dir)
    source = t["books"].join(t["index_state"].select("book_id", "generation"), "book_id").where("book_id % 2 = 0").select("book_id", "revision", "text_hash", "generation")
    chunks = t["chunks"].where("book_id % 2 = 0").withColumn("embedding", F.when(F.col("scene_id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))))
    out, generation = writes.replace_index(t, source, chunks, chunks.limit(0), "m")
    count = lambda c: F.col(c).cast("long").alias(c)
    return out["index_state"].select("book_id", (F.col("generation") == generation).alias("renewed"), count("n_chunks"), count("n_embedded"), count("n_scenes"), F.col("dims"))


@query(f"""WITH {_LIB} SELECT 'scenes' AS name, CAST(id AS VARCHAR) AS id FROM scenes WHERE book_id % 7 <> 0 UNION ALL SELECT 'mentions', CAST(id AS VARCHAR) FROM mentions WHERE book_id % 7 <> 0
UNION ALL SELECT 'book_entities', CAST(id AS VARCHAR) FROM book_entities WHERE book_id % 7 <> 0 UNION ALL SELECT 'events', CAST(id AS VARCHAR) FROM scenes WHERE book_id % 7 <> 0""")
def q_delete_books(spark, sf_dir):
    """What is left after every seventh book is deleted."""
    t = library(spark, sf_dir)
    out = writes.delete_books(t, t["books"].where("book_id % 7 = 0").select("book_id"))
    return named(out, ("scenes", "id"), ("mentions", "id"), ("book_entities", "id"), ("events", "id"))


@query("""WITH e AS (SELECT doc_id AS book_id, unnest(range(len(l))) AS pos, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
p AS (SELECT book_id, pos, CAST(sum(length(t) + 1) OVER (PARTITION BY book_id ORDER BY pos) - length(t) - 1 AS BIGINT) AS s, length(t) AS n FROM e)
SELECT book_id, min(s) AS start_char, max(s + n) AS end_char FROM p WHERE pos < 2 GROUP BY 1""")
def q_migrate_elements(spark, sf_dir):
    """A section over the first two elements of every document, given by positions, with its coordinates."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.split("text", "\n", -1).alias("l"))
    elements = d.select("book_id", F.posexplode("l").alias("pos", "text"))
    sections = d.select("book_id", F.lit("s").alias("id"), F.lit(0).alias("start"), F.least(F.lit(2), F.size("l")).alias("end"))
    out = writes.migrate_elements({"sections": sections}, elements)["sections"]
    return out.select("book_id", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))
