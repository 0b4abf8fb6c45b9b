"""Queries over edits, review and reading: every document of some lines as a book of one section."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import editing, structure
from lectern.plans.book_queries import _UUID
from lectern.plans.registry import query, table

_BOOKS = """l AS (SELECT doc_id AS book_id, string_split(text, chr(10)) AS l FROM documents), books AS (SELECT book_id, l, CAST(len(l) AS INTEGER) AS n FROM l WHERE len(l) >= 6),
elements AS (SELECT book_id, CAST(unnest(range(n)) AS INTEGER) AS pos, unnest(l) AS text, n FROM books)"""


def lined(spark, sf_dir):
    """(books with their number of lines, elements) of documents of six lines or more."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.split("text", "\n", -1).alias("l")).withColumn("n", F.size("l")).where("n >= 6")
    return d, d.select("book_id", "n", F.posexplode("l").alias("pos", "text"))


def whole_section(books):
    """One section a book: title at 0, an epigraph at 1, the body from 2, a note at 4."""
    s = books.select("book_id", F.lit("s").alias("id"), F.lit(0).alias("start"), F.col("n").alias("end"), F.lit(1).alias("level"), F.lit("chapter").alias("role"), F.lit("t").alias("title"), F.lit(0).alias("title_position"), F.lit(2).alias("body_start"), F.col("n").alias("body_end"))
    block = lambda i, role, a, b: books.select("book_id", F.lit(i).alias("id"), F.lit("s").alias("section_id"), F.lit(role).alias("role"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(None).cast("int").alias("attribution_start"))
    return s, block("A", "epigraph", 1, 2).union(block("F", "footnotes", 4, 5))


@query("""WITH iv AS (SELECT user_id, event_id * 3 AS s, event_id * 3 + 1 + event_id % 47 AS e, event_type FROM events),
m AS (SELECT * FROM iv WHERE event_type = 'click'), c AS (SELECT DISTINCT user_id, s AS own, e AS until, unnest(range(s, e)) AS p FROM iv WHERE event_type <> 'click'),
f AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = c.user_id AND m.s <= p AND p < m.e)),
g AS (SELECT user_id, own, p, p - row_number() OVER (PARTITION BY user_id, own ORDER BY p) AS k FROM f)
SELECT user_id, s AS start_char, e AS end_char, true AS manual FROM m UNION ALL SELECT user_id, min(p), max(p) + 1, false FROM g GROUP BY user_id, own, k""")
def q_merge_spans(spark, sf_dir):
    """Clicks as ranges made by hand, other events as automatic ones, by user."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 3).alias("start_char"), (F.col("event_id") * 3 + 1 + F.col("event_id") % 47).alias("end_char"), "event_type")
    return editing.merge_spans(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), ["user_id"])


@query(f"""WITH {_BOOKS}, p AS (SELECT book_id, CASE book_id % 3 WHEN 0 THEN [[1, 4], [4, 6]] WHEN 1 THEN [[2, 6]] ELSE [[0, 2]] END AS r, n FROM books)
SELECT book_id, CAST(unnest(r)[1] AS INTEGER) AS start, CAST(unnest(r)[2] AS INTEGER) AS "end" FROM p WHERE book_id % 4 <> 3""")
def q_split_merges(spark, sf_dir):
    """Automatic merges cut at the ends of blocks; in every fourth book a manual merge is in the way."""
    books, _ = lined(spark, sf_dir)
    b = books.select("book_id")
    k = F.col("book_id") % 3
    merges = b.select("book_id", F.when(k == 0, 1).when(k == 1, 2).otherwise(0).alias("start"), F.when(k == 2, 2).otherwise(6).alias("end"))
    blocks = b.select("book_id", F.when(k == 0, 4).otherwise(9).alias("start"), F.lit(20).alias("end"), F.lit(None).cast("int").alias("attribution_start"))
    manual = b.where("book_id % 4 = 3").select("book_id", F.lit(0).alias("start"), F.lit(9).alias("end"))
    return editing.split_merges(merges, blocks, manual)


_FAULT = "CASE event_id % 9 WHEN 0 THEN 'role' WHEN 1 THEN 'bounds' WHEN 2 THEN 'section' WHEN 3 THEN 'attribution' WHEN 4 THEN 'overlap' END"


@query(f"SELECT user_id AS book_id, 'b' || event_id AS id, {_FAULT} AS problem FROM events WHERE event_id % 9 < 5 UNION ALL SELECT user_id, 'c' || event_id, 'overlap' FROM events WHERE event_id % 9 = 4 AND false")
def q_block_faults(spark, sf_dir):
    """Events as blocks with a fault by their number; each has a section of its own, every fifth kind one with a second block."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), "event_id", (F.col("event_id") % 9).alias("k"))
    section = F.concat(F.lit("s"), "event_id")
    blocks = e.select("book_id", F.concat(F.lit("b"), "event_id").alias("id"), section.alias("section_id"), F.when(F.col("k") == 0, "x").otherwise("epigraph").alias("role"), F.when(F.col("k") == 2, 1).otherwise(4).alias("start"), F.when(F.col("k") == 1, 4).otherwise(8).alias("end"), F.when(F.col("k") == 3, 8).otherwise(F.lit(None)).alias("attribution_start"))
    other = e.where("k = 4").select("book_id", F.concat(F.lit("c"), "event_id").alias("id"), section.alias("section_id"), F.lit("footnotes").alias("role"), F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit(None).cast("int").alias("attribution_start"))
    sections = e.select("book_id", section.alias("id"), F.lit(2).alias("start"), F.lit(9).alias("end"))
    return editing.block_faults(blocks.union(other), sections, e.select("book_id").distinct().withColumn("n_elements", F.lit(20)))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'start' WHEN 1 THEN 'end' WHEN 2 THEN 'level' WHEN 3 THEN 'role' WHEN 4 THEN 'title' WHEN 5 THEN 'context' END AS reason FROM events""")
def q_section_proposals(spark, sf_dir):
    """Events as proposals of sections, all but one kind with a fault."""
    k = F.col("event_id") % 7
    n = lambda bad, at, good: F.when(k == at, bad).otherwise(good)
    rows = table(spark, sf_dir, "events").select("event_id", n(40, 0, F.when(k == 5, 25).otherwise(12)).alias("start"), n(F.lit(11), 1, F.lit(29)).alias("end"), n(11, 2, 3).alias("level"), n("x", 3, "chapter").alias("role"), n(9, 4, 12).alias("title_position"), F.lit(10).alias("visible_from"), F.lit(30).alias("visible_to"), F.lit(10).alias("batch_from"), F.lit(20).alias("batch_to"))
    good, bad = editing.proposals(rows, structure.ROLES)
    return good.select("event_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("event_id", "reason"))


_OPS = ("epigraph", "attribution", "opening", "body", "footnotes", "clear_epigraph")


@query(f"""WITH {_BOOKS}, o AS (SELECT book_id, CASE book_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS body_start, book_id % 6 AS k,
sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(book_id || CASE book_id % 6 WHEN 0 THEN ':epigraph:s:1:3' ELSE ':footnotes:s:1:2' END)) AS h FROM books),
b AS (SELECT book_id, k, body_start, unnest(CASE k WHEN 0 THEN [{{'id': book_id || ':b:' || {_UUID}, 'role': 'epigraph', 's': 1, 'e': 3, 'a': NULL}}, {{'id': 'F', 'role': 'footnotes', 's': 4, 'e': 5, 'a': NULL}}]
WHEN 1 THEN [{{'id': 'A', 'role': 'epigraph', 's': 1, 'e': 3, 'a': 2}}, {{'id': 'F', 'role': 'footnotes', 's': 4, 'e': 5, 'a': NULL}}] WHEN 2 THEN [{{'id': 'F', 'role': 'footnotes', 's': 4, 'e': 5, 'a': NULL}}]
WHEN 3 THEN [{{'id': 'A', 'role': 'epigraph', 's': 1, 'e': 2, 'a': NULL}}] WHEN 4 THEN [{{'id': 'F', 'role': 'footnotes', 's': 4, 'e': 5, 'a': NULL}}, {{'id': book_id || ':b:' || {_UUID}, 'role': 'footnotes', 's': 1, 'e': 2, 'a': NULL}}]
ELSE [{{'id': 'F', 'role': 'footnotes', 's': 4, 'e': 5, 'a': NULL}}] END) AS x FROM o)
SELECT book_id, CAST(body_start AS INTEGER) AS body_start, x.id AS id, x.role AS role, CAST(x.s AS INTEGER) AS start, CAST(x.e AS INTEGER) AS "end", CAST(x.a AS INTEGER) AS attribution_start FROM b""")
def q_edit_openings(spark, sf_dir):
    """One of six edits of the opening of every book, by its number: the section's body start with its blocks."""
    books, elements = lined(spark, sf_dir)
    sections, blocks = whole_section(books)
    k = F.col("book_id") % 6
    op = F.element_at(F.array(*[F.lit(o) for o in _OPS]), (k + 1).cast("int"))
    edits = books.select("book_id", F.lit("s").alias("section_id"), op.alias("operation"), F.when(k == 1, 2).when(k == 3, 3).otherwise(1).alias("start"), F.when(k == 3, 5).when(k.isin(0, 1), 3).otherwise(2).alias("end"))
    s, b, _ = editing.edit_openings(sections, blocks, elements.withColumn("type", F.lit("NarrativeText")), edits)
    return s.select("book_id", "body_start").join(b, "book_id").select("book_id", "body_start", "id", "role", "start", "end", "attribution_start")


@query(f"""WITH {_BOOKS}, p AS (SELECT book_id, n, l, unnest([[0, 2], [2, 4], [4, n]]) AS r FROM books)
SELECT book_id, CASE WHEN r[1] = 0 THEN 's' ELSE 's:' || r[1] END AS id, CAST(r[1] AS INTEGER) AS start, CAST(r[2] AS INTEGER) AS "end",
CASE WHEN r[1] = 0 THEN 't' WHEN length(trim(l[r[1] + 1])) BETWEEN 1 AND 180 THEN trim(l[r[1] + 1]) END AS title FROM p""")
def q_split_sections(spark, sf_dir):
    """Every section cut at its third and fifth element."""
    books, elements = lined(spark, sf_dir)
    sections, _ = whole_section(books)
    cuts = books.select("book_id", F.lit("s").alias("id"), F.explode(F.array(F.lit(2), F.lit(4))).alias("at"))
    return editing.split_sections(sections, cuts, elements)[0].select("book_id", "id", "start", "end", "title")


@query("""WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS back FROM events)
SELECT user_id, event_id, CAST(back AS INTEGER) AS back, back = 1 AS undone FROM v WHERE back <= 20""")
def q_undo_history(spark, sf_dir):
    """Events as versions of a user's structure: what can be undone, and what undoing gives."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    last = editing.undone(e, ["user_id"], "event_id").withColumn("undone", F.lit(True))
    return editing.history(e, ["user_id"], "event_id").join(last, ["user_id", "event_id"], "left").withColumn("undone", F.coalesce("undone", F.lit(False)))


@query(f"""WITH {_BOOKS} SELECT book_id, CAST(book_id % 5 AS INTEGER) AS n, CASE WHEN book_id % 5 = 4 THEN NULL ELSE 's' END AS section_id,
CAST(CASE book_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 99999 END AS INTEGER) AS position, CAST(CASE book_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 4 ELSE 100000 END AS INTEGER) AS end_position,
CASE book_id % 5 WHEN 0 THEN 'epigraph' WHEN 1 THEN 'heading' WHEN 2 THEN 'attribution' WHEN 3 THEN 'body' ELSE 'unknown' END AS block_type FROM books""")
def q_review_items(spark, sf_dir):
    """A message about every book's section or a position in it, with its place."""
    books, _ = lined(spark, sf_dir)
    sections, blocks = whole_section(books)
    k = F.col("book_id") % 5
    message = F.when(k == 0, "Начало раздела 0: проверьте").when(k == 1, "see position: 0").when(k == 2, "{'position': 4}").when(k == 3, "positions 3 and 5").otherwise("position = 99999")
    return editing.review_items(books.select("book_id", k.cast("int").alias("n"), message.alias("message")), sections, blocks).drop("message")


@query(f"""WITH {_BOOKS} SELECT book_id, CASE WHEN pos = 3 THEN 2 ELSE pos END AS first, CAST(max(pos) AS INTEGER) AS last, CASE min(pos) WHEN 0 THEN 'heading' WHEN 1 THEN 'epigraph' WHEN 4 THEN 'footnotes' ELSE 'body' END AS role, sha256(string_agg(text, chr(10) ORDER BY pos)) AS text_hash FROM elements GROUP BY 1, 2""")
def q_reader_view(spark, sf_dir):
    """Books as a reader sees them; the third and fourth elements are shown as one."""
    books, elements = lined(spark, sf_dir)
    sections, blocks = whole_section(books)
    merges = books.select("book_id", F.lit(2).alias("start"), F.lit(4).alias("end"))
    return editing.reader_view(elements.drop("n"), sections, blocks, merges).select("book_id", "first", "last", "role", T.content_hash(F.col("text")).alias("text_hash"))


@query("SELECT doc_id AS book_id, s AS start_char, sha256(substr(text, s + 1, 500)) AS text_hash, CASE WHEN s + 500 < length(text) THEN s + 500 END AS next_start FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS s FROM documents)")
def q_read_text(spark, sf_dir):
    """All texts read in pages of 500 characters."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "text").where(F.length("text") > 0)
    pages = d.select("book_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - 1, F.lit(500).cast("long"))).alias("start_char"), F.length("text").cast("long").alias("end_char"))
    return editing.read_text(d, pages, 500).select("book_id", "start_char", T.content_hash(F.col("text")).alias("text_hash"), F.col("next_start").cast("long").alias("next_start"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'stale' ELSE 'partial' END"


@query(f"""SELECT o_custkey AS book_id, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS nth FROM orders WHERE {_STATUS} <> 'stale'""")
def q_readable_scenes(spark, sf_dir):
    """Orders as scenes of chapters by their status; stale chapters aren't shown."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderstatus").alias("chapter_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start_char"), F.lit(0).alias("end_char"))
    status = F.when(F.col("chapter_id") == "F", "ready").when(F.col("chapter_id") == "O", "stale").otherwise("partial")
    layers = o.select("book_id", "chapter_id").distinct().withColumn("status", status)
    return editing.readable_scenes(layers, o).select("book_id", "id", "nth")


@query("""WITH s AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer), l AS (SELECT c_nationkey, c_mktsegment, max(c_custkey) AS m FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2)
SELECT CAST(s.c_nationkey AS BIGINT) AS book_id, s.c_mktsegment AS id, CASE WHEN m IS NULL THEN 'not_started' WHEN m % 2 = 0 THEN 'ready' ELSE 'failed' END AS scene_status FROM s LEFT JOIN l USING (c_nationkey, c_mktsegment)""")
def q_outline_status(spark, sf_dir):
    """Segments as chapters of nations' books, with the state of their scenes."""
    c = table(spark, sf_dir, "customer").withColumn("book_id", F.col("c_nationkey").cast("long"))
    sections = c.select("book_id", F.col("c_mktsegment").alias("id")).distinct()
    layers = c.where("c_acctbal > 5000").groupBy("book_id", F.col("c_mktsegment").alias("chapter_id")).agg(F.when(F.max("c_custkey") % 2 == 0, "ready").otherwise("failed").alias("status"))
    return editing.outline(sections, layers)


@query(f"""WITH {_BOOKS} SELECT book_id, 's' AS id FROM elements WHERE pos >= 2 GROUP BY 1 HAVING count(CASE WHEN book_id % 2 = 1 AND pos <> 4 AND trim(text) <> '' AND pos < 5 THEN 1 END) = 0""")
def q_without_scene_text(spark, sf_dir):
    """Sections whose third to fifth elements are blank but for a note; in every second book all of them are notes."""
    books, elements = lined(spark, sf_dir)
    sections, blocks = whole_section(books)
    blocks = blocks.withColumn("start", F.when((F.col("role") == "footnotes") & (F.col("book_id") % 2 == 0), 2).otherwise(F.col("start")))
    return editing.without_scene_text(sections.withColumn("body_end", F.lit(5)), elements, blocks)
