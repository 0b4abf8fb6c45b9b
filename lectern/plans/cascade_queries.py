"""Queries over whole libraries: what is left of all tables after a write, keys that are missing, deep trees, section bounds, index inputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import fulltext, indexing, structure, writes
from lectern.plans.registry import query, table
from lectern.plans.write_queries import _LIB, _VOID, library, named, rewritten

#: The tables of ``whole`` in SQL, beside those of ``_LIB``.
_WHOLE = f"""{_LIB},
nexts AS (SELECT * FROM (SELECT book_id, id AS source_id, lead(id) OVER (PARTITION BY book_id ORDER BY id) AS target_id FROM scenes) WHERE target_id IS NOT NULL),
entities AS (SELECT DISTINCT book_id, book_id * 10 + id % 10 AS id FROM mentions),
refers AS (SELECT book_id, id AS mention_id, scene_id, book_id * 10 + id % 10 AS entity_id FROM mentions),
same AS (SELECT a.book_id, a.id AS left_id, a.id + 1 AS right_id FROM book_entities a JOIN book_entities b ON b.book_id = a.book_id AND b.id = a.id + 1 WHERE a.id % 10 = 1),
chapters AS (SELECT DISTINCT book_id, chapter_id FROM scenes), books AS (SELECT DISTINCT book_id FROM scenes)"""
#: A key of each table, to tell what is left.
_KEYS = (
    ("books", "book_id"), ("sections", "id"), ("blocks", "id"), ("layers", "chapter_id"), ("scenes", "id"), ("chunks", "id"), ("annotations", "chunk_id"), ("mentions", "id"), ("references", "id"),
    ("chapter_entities", "id"), ("resolves", "chapter_entity_id"), ("book_entities", "id"), ("possibly_same", "left_id"), ("entities", "id"), ("refers", "mention_id"), ("events", "id"),
    ("event_links", "source_id"), ("scene_links", "source_id"), ("summary_embeddings", "id"), ("index_state", "book_id"),
)


def whole(spark, sf_dir) -> writes.Tables:
    """The library of ``write_queries`` with all 20 tables filled and no key missing: links lead to the next scene of the book."""
    t = library(spark, sf_dir)
    following = F.lead("id").over(Window.partitionBy("book_id").orderBy("id"))
    links = t["scenes"].select("book_id", F.col("id").alias("source_id"), following.alias("target_id")).where("target_id is not null")
    named_by = t["mentions"].select("book_id", F.col("id").alias("mention_id"), (F.col("book_id") * 10 + F.col("id") % 10).alias("entity_id"))
    pair = t["book_entities"].select("book_id", F.col("id").alias("right_id"))
    same = t["book_entities"].where("id % 10 = 1").select("book_id", F.col("id").alias("left_id")).join(pair, "book_id").where("right_id = left_id + 1").withColumn("score", F.lit(0.5))
    listed = t["mentions"].groupBy("book_id", "scene_id").agg(F.collect_list(F.col("id").cast("string")).alias("ids"))  # by scene, so that few rows meet the scenes
    own = listed.join(t["scenes"].select("book_id", F.col("id").alias("scene_id"), "chapter_id"), ["book_id", "scene_id"]).groupBy("book_id", "chapter_id").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("mention_ids"))
    return t | {
        "scene_links": links, "event_links": links, "refers": named_by, "entities": named_by.select("book_id", F.col("entity_id").alias("id")).distinct(), "possibly_same": same,
        "chapter_entities": t["chapter_entities"].join(own, ["book_id", "chapter_id"], "left"),
        "summary_embeddings": t["scenes"].select("book_id", "id", F.array(F.lit(1.0)).alias("embedding")),
    }


def _left(out: writes.Tables):
    return named(out, *_KEYS)


def _sql(**conditions: str) -> str:
    """SELECT of what is left: table -> condition, all rows where none is given."""
    sources = {
        "books": ("books", "book_id"), "sections": ("chapters", "chapter_id"), "blocks": ("chapters", "book_id || ':' || chapter_id"), "layers": ("chapters", "chapter_id"), "scenes": ("scenes", "id"),
        "chunks": ("scenes", "id"), "annotations": ("scenes", "id"), "mentions": ("mentions", "id"), "references": ("mentions", "id"), "chapter_entities": ("ce", "id"), "resolves": ("rs", "chapter_entity_id"),
        "book_entities": ("be", "id"), "possibly_same": ("ps", "left_id"), "entities": ("entities", "id"), "refers": ("refers", "mention_id"), "events": ("scenes", "id"),
        "event_links": ("nexts", "source_id"), "scene_links": ("nexts", "source_id"), "summary_embeddings": ("scenes", "id"), "index_state": ("books", "book_id"),
    }
    return "\nUNION ALL ".join(f"SELECT '{n}' AS name, CAST({k} AS VARCHAR) AS id FROM {s} x" + (f" WHERE {conditions[n]}" if n in conditions else "") for n, (s, k) in sources.items())


_HELD = """rs AS (SELECT r.* FROM resolves r WHERE chapter_entity_id IN (SELECT id FROM ce)),
lost AS (SELECT DISTINCT book_id FROM resolves WHERE chapter_entity_id NOT IN (SELECT id FROM ce)),
be AS (SELECT * FROM book_entities b WHERE book_id NOT IN (SELECT book_id FROM lost) OR EXISTS (SELECT 1 FROM rs WHERE rs.book_id = b.book_id AND rs.book_entity_id = b.id)),
ps AS (SELECT * FROM same s WHERE EXISTS (SELECT 1 FROM be WHERE be.book_id = s.book_id AND be.id = left_id) AND EXISTS (SELECT 1 FROM be WHERE be.book_id = s.book_id AND be.id = right_id))"""
_ALIVE = "NOT EXISTS (SELECT 1 FROM void v WHERE v.book_id = x.book_id AND v.id {})"


@query(f"""WITH {_WHOLE}, {_VOID}, ce AS (SELECT * FROM chapter_entities c WHERE NOT EXISTS (SELECT 1 FROM void v WHERE v.book_id = c.book_id AND v.chapter_id = c.chapter_id)), {_HELD}
""" + _sql(scenes="NOT (book_id % 3 = 0 AND id % 5 = 0)", chunks="book_id % 3 <> 0", annotations="book_id % 3 <> 0", mentions=_ALIVE.format("= x.scene_id"), references=_ALIVE.format("= x.scene_id"), refers=_ALIVE.format("= x.scene_id"), events=_ALIVE.format("= x.id"),
           event_links=_ALIVE.format("IN (x.source_id, x.target_id)"), scene_links=_ALIVE.format("IN (x.source_id, x.target_id)"), summary_embeddings=_ALIVE.format("= x.id"), index_state="book_id % 3 <> 0"))
def q_cascade_layers(spark, sf_dir):
    """All 20 tables after every third book's scene layers are written again; no text is left to cut chunks from."""
    t = whole(spark, sf_dir)
    return _left(writes.write_layers(t, *rewritten(t)))


@query(f"""WITH {_WHOLE}, ce AS (SELECT * FROM chapter_entities c WHERE NOT EXISTS (SELECT 1 FROM scenes s WHERE s.book_id = c.book_id AND s.chapter_id = c.chapter_id AND s.id % 4 = 0)), {_HELD}
""" + _sql(mentions="scene_id % 4 <> 0 OR id % 2 = 1", references="scene_id % 4 <> 0", refers="scene_id % 4 <> 0 OR mention_id % 2 = 1"))  # fmt: skip
def q_cascade_mentions(spark, sf_dir):
    """All 20 tables after every fourth scene lost its references and its even mentions."""
    t = whole(spark, sf_dir)
    src = t["scenes"].where("id % 4 = 0").select("book_id", "chapter_id", F.col("id").alias("scene_id"), "text_hash")
    kept = t["mentions"].where("scene_id % 4 = 0 and id % 2 = 1")
    return _left(writes.replace_mentions(t, src, kept, t["references"].limit(0)))


@query(f"WITH {_WHOLE}, ce AS (SELECT * FROM chapter_entities), {_HELD}\n" + _sql(events="id % 3 <> 0", event_links="source_id % 3 <> 0 AND target_id % 3 <> 0", annotations="id % 3 <> 0"))
def q_cascade_annotations(spark, sf_dir):
    """All 20 tables after every third scene's annotations and events were replaced by none."""
    t = whole(spark, sf_dir)
    src = t["scenes"].where("id % 3 = 0").select("book_id", F.col("id").alias("scene_id"), "text_hash")
    return _left(writes.replace_annotations(t, src, t["annotations"].limit(0), t["events"].limit(0)))


@query(f"""WITH {_WHOLE}, ce AS (SELECT * FROM chapter_entities), rs AS (SELECT * FROM resolves), be AS (SELECT * FROM book_entities b WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.book_id % 2 = 0 AND s.book_id = b.book_id AND s.right_id = b.id)),
ps AS (SELECT * FROM same WHERE book_id % 2 <> 0)
""" + _sql())  # fmt: skip
def q_cascade_merges(spark, sf_dir):
    """All 20 tables after the two entities of every second book were merged: resolutions are repointed, pairs go."""
    t = whole(spark, sf_dir)
    merges = t["possibly_same"].where("book_id % 2 = 0").select("book_id", F.col("right_id").alias("loser_id"), F.col("left_id").alias("survivor_id"))
    return _left(writes.merge_entities(t, merges, merges.select("book_id", F.col("survivor_id").alias("id"))))


@query(f"""WITH {_LIB} SELECT DISTINCT name, 'target_id' AS "column", CAST(book_id AS VARCHAR) AS book_id, CAST(id + 1 AS VARCHAR) AS key FROM scenes s, (SELECT unnest(['scene_links', 'event_links']) AS name)
WHERE NOT EXISTS (SELECT 1 FROM scenes o WHERE o.book_id = s.book_id AND o.id = s.id + 1)""")
def q_missing_keys(spark, sf_dir):
    """Keys that rows of a library name and that aren't there: links to the next order, which is mostly another book's."""
    return writes.missing(library(spark, sf_dir))


@query("""WITH RECURSIVE p AS (SELECT CAST(p_partkey // 41 AS BIGINT) AS book_id, p_partkey AS id, CASE WHEN p_partkey % 41 > 0 THEN p_partkey - 1 END AS parent_id FROM part),
x AS (SELECT book_id, id AS root, id, 0 AS level FROM p WHERE parent_id IS NULL UNION ALL SELECT x.book_id, x.root, p.id, x.level + 1 FROM x JOIN p ON p.book_id = x.book_id AND p.parent_id = x.id) SELECT * FROM x""")
def q_deep_closure(spark, sf_dir):
    """Chains of 40 levels: parts below the first of each 41."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 41).alias("book_id"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 41 > 0, F.col("p_partkey") - 1).alias("parent_id"))
    return structure.closure(p, p.where("parent_id is null"), by=("book_id",))


@query("""WITH s AS (SELECT row_number() OVER () AS k, l_suppkey AS book_id, l_orderkey AS start, l_linenumber AS n, CAST(l_partkey % 31 AS INTEGER) AS level FROM lineitem)
SELECT a.book_id, a.start, a.n, a.level, coalesce(min(b.start), 1000000000) AS "end" FROM s a LEFT JOIN s b ON b.book_id = a.book_id AND b.start > a.start AND b.level <= a.level GROUP BY a.k, a.book_id, a.start, a.n, a.level""")
def q_next_bounds(spark, sf_dir):
    """Ends of sections of 31 levels: line items of a supplier in the order of their numbers."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book_id"), F.col("l_orderkey").alias("start"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 31).cast("int").alias("level"), F.lit(1_000_000_000).cast("long").alias("total"))
    return structure.next_bound(s).drop("total")


_TOKENS = "regexp_extract_all(lower(text), '[\\pL\\pN]+')"


@query(f"""WITH w AS (SELECT source AS book_id, doc_id, {_TOKENS} AS w FROM documents), q AS (SELECT DISTINCT book_id, unnest(arg_min(w, doc_id)[1:3]) AS token FROM w GROUP BY book_id),
s AS (SELECT book_id, count(*) AS docs, avg(len(w)) AS mean FROM w GROUP BY book_id),
t AS (SELECT book_id, doc_id, token, dl, count(*) AS tf FROM (SELECT book_id, doc_id, len(w) AS dl, unnest(w) AS token FROM w) JOIN q USING (book_id, token) GROUP BY ALL),
d AS (SELECT book_id, token, count(*) AS df FROM t GROUP BY ALL),
b AS (SELECT book_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score FROM t JOIN d USING (book_id, token) JOIN s USING (book_id) GROUP BY ALL)
SELECT book_id, CAST(doc_id AS VARCHAR) AS id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY book_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank FROM b QUALIFY rank <= 10""")
def q_blockmax_topk(spark, sf_dir):
    """The ten best documents of each source for the first words of its first document, from an index in blocks; not all blocks are read."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("start_char"), (F.col("doc_id") + 1).alias("end_char"), "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    asked = d.groupBy("book_id").agg(F.min_by(words, "id").alias("w")).select("book_id", F.explode(F.slice("w", 1, 3)).alias("token")).distinct()
    blocks, stats = fulltext.build(fulltext.postings(d, stemmed=False), F.floor(F.col("start_char") / 64), asked)
    hits, _ = fulltext.search(blocks, stats, asked, 10)
    return hits.select("book_id", "id", F.round("score", 6).alias("score"), "rank")


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'In ' || lang || chr(10) || chr(10) || text ELSE text END AS input FROM documents WHERE doc_id % 5 <> 1)
SELECT sha256(input) AS hash, min(input) AS text FROM (SELECT input FROM c UNION ALL SELECT rtrim(ltrim(lang)) || chr(10) || source FROM documents WHERE doc_id % 7 = 0 AND doc_id % 5 <> 1)
WHERE sha256(input) NOT IN (SELECT sha256(input) FROM c WHERE doc_id % 3 = 0) GROUP BY 1""")
def q_index_misses(spark, sf_dir):
    """What an index embeds anew: inputs with contexts, and scenes, whose hashes no chunk of a document divisible by three has; two of ten books aren't asked for."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select((F.col("doc_id") % 5).alias("book_id"), F.col("lang").alias("chapter_id"), F.col("doc_id").alias("id"), "text")
    t = {
        "books": chunks.select("book_id").distinct(), "chunks": chunks,
        "annotations": d.where("doc_id % 4 = 0").select((F.col("doc_id") % 5).alias("book_id"), F.col("doc_id").alias("chunk_id"), F.concat(F.lit("In "), "lang").alias("context")),
        "scenes": d.where("doc_id % 7 = 0").select((F.col("doc_id") % 5).alias("book_id"), F.col("lang").alias("chapter_id"), F.col("doc_id").alias("id"), F.concat(F.lit(" "), "lang").alias("title"), F.col("source").alias("summary")),
    }
    books = t["books"].where("book_id <> 1")
    inputs = indexing.chunk_inputs(t, books)
    cache = inputs.where("id % 3 = 0").select(F.col("embedding_hash").alias("hash"), F.lit("m").alias("model"))
    return indexing.misses(inputs, indexing.scene_inputs(t, books), cache, "m")
