
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import entities, narrative, prepare, scenes, search, sections, sessions, structure, vectors
from lectern.plans.graph_queries import tree
from lectern.plans.registry import query, table
from lectern.plans.text_queries import _LINES, documents
from lectern.sources import books, html


@query()
def q_books_from_pages(spark, sf_dir):
    """Pages as HTML books: ids, hashes, titles and numbers of elements."""
    files = table(spark, sf_dir, "pages").select(F.concat("url", F.lit("/index.html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return books.parse_files(files).select("path", "book_id", "text_hash", "title", "error", F.size("elements").alias("n"))


@query()
def q_section_tree(spark, sf_dir):
    """Section trees of all pages from their headings."""
    b = html.blocks(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page_id"), "html"), "page_id").withColumnRenamed("page_id", "book_id")
    none = spark.createDataFrame([], "book_id string, pos int, depth int, title string")
    return sections.build(b, none).select("book_id", "start", "end", "level", "role", "title", "problem")


@query(f"""WITH {_LINES} SELECT doc_id, CASE WHEN pos = 0 THEN 'epigraph' ELSE 'body' END AS role, sha256(string_agg(element, chr(10) ORDER BY pos)) AS text_hash, min(pos)::INTEGER AS start FROM lines GROUP BY 1, 2""")
def q_content_blocks(spark, sf_dir):
    """Every document as a section whose first line is an epigraph."""
    lines = structure.elements(documents(spark, sf_dir).withColumnRenamed("doc_id", "book_id"), "book_id")
    n = documents(spark, sf_dir).select(F.col("doc_id").alias("book_id"), F.size(F.split("text", "\n", -1)).alias("n"))
    s = n.select("book_id", F.lit("s").alias("id"), F.lit(0).alias("body_start"), F.col("n").alias("body_end"))
    notes = n.select("book_id", F.lit("s").alias("section_id"), F.lit("epigraph").alias("role"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    return structure.content_blocks(lines, s, notes).select(F.col("book_id").alias("doc_id"), "role", T.content_hash(F.col("text")).alias("text_hash"), "start")


@query()
def q_scene_segments(spark, sf_dir):
    """Scenes of every document as a chapter, by the default boundary function."""
    u = documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentence_units(F.col("text"))).alias("unit", "text"))
    return scenes.segment(u.select(F.col("doc_id").alias("chapter_id"), "unit", "text"))


_PRON = ", ".join(f"'{p}'" for p in entities.PRONOUNS)
#: SQL of a version 5 identifier in the URL namespace of the text in column k, without hyphens.
_UUID = """substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INTEGER, 1) || substr(h, 18, 15)"""


@query(f"""WITH f AS (SELECT doc_id, text, regexp_extract(text, '^[\\pL\\pN_]+') AS s FROM documents),
m AS (SELECT CAST(doc_id AS VARCHAR) AS scene_id, s AS surface_text, 0 AS start_offset, CAST(length(s) AS INTEGER) AS end_offset, regexp_extract_all(s, '[A-Za-zА-Яа-яЁё0-9]+') AS w,
sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('b:' || doc_id || ':' || sha256(text) || ':0:' || length(s))) AS h FROM f WHERE s <> '')
SELECT scene_id, 'mention:' || {_UUID} AS mention_id, surface_text, start_offset, end_offset FROM m WHERE len(list_filter(w, lambda x: regexp_matches(x, '^[A-ZА-ЯЁ]|[0-9]'))) > 0 AND len(list_filter(w, lambda x: replace(lower(x), 'ё', 'е') NOT IN ({_PRON}))) > 0""")
def q_mentions(spark, sf_dir):
    """The first word of every document as a proposed mention without a confidence; those with an individual mark stay."""
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("scene_id"), "text", F.regexp_extract("text", r"(?U)^\w+", 0).alias("s"), F.lit("b").alias("book_id"))
    replies = d.where("s <> ''").select("scene_id", F.lit(1).alias("seq"), F.col("s").alias("surface_text"), F.lit(0).alias("start_offset"), F.length("s").alias("end_offset"), F.lit(None).cast("int").alias("occurrence"), F.lit("person").alias("entity_type"), F.lit(None).cast("double").alias("confidence"))
    good, _ = entities.mention_rows(replies, d.select("scene_id", "book_id", "text", T.content_hash(F.col("text")).alias("text_hash")))
    return good.select("scene_id", "mention_id", "surface_text", "start_offset", "end_offset")


_TYPE = "CASE event_type WHEN 'view' THEN 'retells' WHEN 'click' THEN 'parallels' WHEN 'purchase' THEN 'none' WHEN 'signup' THEN 'causes' ELSE 'huh' END"


@query(f"""WITH r AS (SELECT event_id % 700 AS pair_id, event_id AS seq, {_TYPE} AS type, value FROM events), g AS (SELECT * FROM r WHERE type <> 'huh' QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY seq) = 1)
SELECT p.pair_id, coalesce(type, 'none') AS type, CASE WHEN type IN ('retells', 'causes') THEN 'right_to_left' END AS direction, CASE WHEN type IS NULL THEN 0.0 ELSE round(greatest(0.0, least(1.0, value)), 6) END AS confidence FROM (SELECT unnest(range(800)) AS pair_id) p LEFT JOIN g USING (pair_id)""")
def q_link_decisions(spark, sf_dir):
    """Events as replies about 800 pairs: the first known type counts, none without one."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "retells").when(F.col("event_type") == "click", "parallels").when(F.col("event_type") == "purchase", "none").when(F.col("event_type") == "signup", "causes").otherwise("huh")
    r = e.select((F.col("event_id") % 700).alias("pair_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.lit(None).cast("string").alias("subtype"), F.lit("right_to_left").alias("direction"), F.lit("inferred").alias("basis"), F.col("value").alias("confidence"), F.lit("").alias("reason"))
    pairs = spark.range(800).select(F.col("id").alias("pair_id"), F.lit("a").alias("left_id"), F.lit("b").alias("right_id"))
    return narrative.link_decisions(pairs, r).select("pair_id", "type", "direction", F.round("confidence", 6).alias("confidence"))


@query("""WITH d AS (SELECT event_id % 300 AS pair_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'same' WHEN 'view' THEN 'new' ELSE 'x' END AS decision FROM events), g AS (SELECT * FROM d WHERE decision <> 'x' QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY seq) = 1)
SELECT p.pair_id, coalesce(decision, 'uncertain') AS decision FROM (SELECT unnest(range(320)) AS pair_id) p LEFT JOIN g USING (pair_id)""")
def q_decisions(spark, sf_dir):
    """Decisions on 320 pairs, uncertain by default."""
    d = table(spark, sf_dir, "events").select((F.col("event_id") % 300).alias("pair_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "same").when(F.col("event_type") == "view", "new").otherwise("x").alias("decision"))
    return entities.decisions(spark.range(320).withColumnRenamed("id", "pair_id"), d, ["same", "new"], "uncertain")


@query("""SELECT user_id AS run_id, event_id AS seq, count(*) OVER w <= 20 AND sum(event_id % 90 + 10) OVER w <= 900 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_budget(spark, sf_dir):
    """Requests of each run while 20 calls and 900 tokens last."""
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 90 + 10).alias("tokens"))
    return sessions.within_budget(r, 20, 900).select("run_id", "seq", "allowed")


@query("WITH u AS (SELECT conv_id, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1) SELECT conv_id AS conversation_id, substr(trim(text), 1, 60) AS title FROM u")
def q_chat_titles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.struct("turn", "text").alias("position"), "role", "text")
    return sessions.chat_titles(c)


@query("SELECT conv_id AS conversation_id, max(turn) + 1 AS position, 'assistant' AS role FROM conversations GROUP BY 1")
def q_chat_append(spark, sf_dir):
    """An answer appended to every conversation."""
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("position"), "role", "text")
    new = m.select("conversation_id").distinct().select("conversation_id", F.lit(1).alias("seq"), F.lit("assistant").alias("role"), F.lit("added").alias("text"))
    return sessions.append_messages(m, new).where("text = 'added' and role = 'assistant'").select("conversation_id", "position", "role")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def q_review_latest(spark, sf_dir):
    """The last event of each user and type: the batch form of the review stream's upsert."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    keys = ["user_id", "event_type"]
    had, last = sessions.latest(old, keys, "event_id"), sessions.latest(new, keys, "event_id")
    newer = last.join(had.withColumnRenamed("event_id", "had"), keys, "left").where("had is null or event_id > had").drop("had")
    return sessions.upsert(had, newer, keys)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_unique_violations(spark, sf_dir):
    """Keys that are not unique."""
    return structure.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'edited' ELSE p_name END AS title, CASE WHEN p_partkey % 5 = 0 THEN 'human' ELSE 'automatic' END AS origin FROM part WHERE p_partkey % 7 <> 0 OR p_partkey % 5 = 0""")
def q_overrides(spark, sf_dir):
    """Automatic rows, human rows in their place, suppressed ones gone."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return structure.override(a, a.where("id % 5 = 0").withColumn("title", F.lit("edited")), a.where("id % 7 = 0").select("id"), ["id"])


@query("SELECT o_custkey AS book_id, o_orderkey AS id, n, CAST(floor((n - 1) / 6) AS BIGINT) AS \"group\" FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)")
def q_focus_groups(spark, sf_dir):
    """Scenes of each book in consecutive sixes."""
    w = Window.partitionBy("book_id").orderBy("o_orderdate", "id")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("id"), "o_orderdate").withColumn("n", F.row_number().over(w).cast("long"))
    return narrative.focus_groups(s.drop("o_orderdate"))


@query()
def q_outline(spark, sf_dir):
    """Outlines of customers as books, their orders as scenes."""
    w = Window.partitionBy("book_id").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), "o_orderkey", F.col("o_orderpriority").alias("chapter"), F.col("o_orderstatus").alias("title"), F.concat(F.lit("Order. Total "), F.col("o_totalprice").cast("string")).alias("summary"))
    got = narrative.outline(o.withColumn("n", F.row_number().over(w)).drop("o_orderkey"), 400)
    return got.select("book_id", F.size("lines").alias("n"), "gist_chars")


@query("""WITH s AS (SELECT o_custkey AS chapter_id, o_orderkey AS scene_id, o_orderstatus AS h FROM orders), l AS (SELECT DISTINCT l_orderkey AS scene_id, l_linestatus AS h FROM lineitem), a AS (SELECT DISTINCT l_orderkey AS scene_id, l_linestatus AS h FROM lineitem WHERE l_returnflag = 'R')
SELECT c_custkey AS chapter_id, count(s.scene_id) AS scenes, CAST(count(CASE WHEN s.h <> 'P' THEN 1 END) AS BIGINT) AS ready, count(l.scene_id) AS extracted, count(a.scene_id) AS annotated FROM customer LEFT JOIN s ON s.chapter_id = c_custkey LEFT JOIN l ON l.scene_id = s.scene_id AND l.h = s.h LEFT JOIN a ON a.scene_id = s.scene_id AND a.h = s.h GROUP BY 1""")
def q_preparation_status(spark, sf_dir):
    """Chapters with how many scenes are ready, extracted and annotated for their present text."""
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chapter_id"), F.col("o_orderkey").alias("scene_id"), F.col("o_orderstatus").alias("text_hash"), F.when(F.col("o_orderstatus") != "P", "ready").otherwise("partial").alias("status"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_linestatus").alias("text_hash"), F.when(F.col("l_returnflag") == "R", "ready").otherwise("failed").alias("status"))
    return prepare.status(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chapter_id")), s, l, l)


@query("""WITH d AS (SELECT doc_id, sha256(text) AS hash FROM documents) SELECT DISTINCT hash, CAST(64 AS INTEGER) AS dimensions FROM d WHERE hash NOT IN (SELECT hash FROM d WHERE doc_id % 3 = 0)""")
def q_embed_misses(spark, sf_dir):
    """Texts that the cache lacks, embedded offline: one vector for each distinct text."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), T.content_hash(F.col("text")).alias("hash"), "text")
    cache = d.where("seq % 3 = 0").select("hash", F.lit("m").alias("model")).distinct()
    return vectors.embed(vectors.cache_misses(d, cache, "m"), vectors.hashing_embedder()).select("hash", F.size("embedding").alias("dimensions"))


@query("""WITH t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer) SELECT coalesce(parent_id, '') AS parent_id, count(*) AS children FROM t GROUP BY 1""")
def q_tree_children(spark, sf_dir):
    return tree(spark, sf_dir).groupBy(F.coalesce("parent_id", F.lit("")).alias("parent_id")).agg(F.count("*").alias("children"))


@query()
def q_verdicts(spark, sf_dir):
    """Every benchmark item as a verdict on itself: the quote is its first sentences that hold the evidence."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.lit(0).alias("start_char"))
    v = b.select("id", F.lit("relevant").alias("status"), F.lit("r").alias("reason"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), " ").alias("evidence"), F.lit(1).alias("seq"))
    return search.apply_verdicts(b, v).select("id", "review_status", "verified", "quote_start", "quote_end")
