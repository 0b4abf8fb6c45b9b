"""Queries over entity resolution: customers as mentions in nations' chapters of regions' books, resolved by a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import resolution
from lectern.plans.book_queries import _UUID
from lectern.plans.registry import query, table


def by_surface(batch, offered, known):
    """The rule of the oracle: a mention is the candidate of its very name, else a new entity with its likes in the batch."""
    rows, new = [], {}
    for m in batch:
        same = [i for i in offered[m["id"]] if known[i].name == m["surface"]]
        if same:
            rows.append({"mention_ids": [m["id"]], "entity_id": same[0]})
        else:
            new.setdefault(m["surface"], []).append(m["id"])
    return {"resolutions": rows + [{"mention_ids": ids, "new_entity": {"canonical_name": s}} for s, ids in new.items()]}


def by_name(source, near):
    """The same rule for chapter entities."""
    same = [c.id for c in near if c.name == source.name]
    return {"resolutions": [{"chapter_entity_id": source.id, "decision": "same_entity" if same else "new_entity", "entity_id": same[0] if same else None}]}


def chapters(spark, sf_dir, ask_pairs=None):
    """Chapter entities of the customers' segments."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("string").alias("book_id")), "c_nationkey")
    scenes = c.select("book_id", F.col("c_nationkey").cast("string").alias("chapter_id"), F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("rank"), F.concat(F.lit("by "), "c_mktsegment").alias("text"))
    mentions = c.select("book_id", F.col("c_custkey").cast("string").alias("scene_id"), F.concat(F.lit("m"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("surface_text"), F.lit("group").alias("entity_type"), F.lit(None).cast("string").alias("canonical_name_hint"), F.lit(3).alias("start_offset"), (F.lit(3) + F.length("c_mktsegment")).alias("end_offset"))
    return resolution.resolve_chapters(mentions, scenes, by_surface, ask_pairs)


_C = "c AS (SELECT CAST(n_regionkey AS VARCHAR) AS book_id, CAST(c_nationkey AS VARCHAR) AS chapter_id, c_custkey AS k, c_mktsegment AS seg FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@query(f"""WITH {_C}, g AS (SELECT book_id, chapter_id, seg, min(k) AS first, count(*) AS n FROM c GROUP BY 1, 2, 3),
x AS (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(book_id || ':' || chapter_id || ':m' || first)) AS h FROM g)
SELECT book_id, chapter_id, 'chapter-entity:' || {_UUID} AS id, seg AS canonical_name, n AS mentions, 'by ' || seg AS context FROM x""")
def q_resolve_chapters(spark, sf_dir):
    """Mentions clustered in every chapter, in batches of twelve; a cluster is named by its first mention."""
    return chapters(spark, sf_dir).select("book_id", "chapter_id", "id", "canonical_name", F.size("mention_ids").cast("long").alias("mentions"), F.try_element_at("representative_contexts", F.lit(1)).alias("context"))


@query(f"""WITH {_C}, g AS (SELECT book_id, chapter_id, seg, min(k) AS first FROM c GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY book_id, seg ORDER BY CAST(chapter_id AS INTEGER)) AS r, count(*) OVER (PARTITION BY book_id, seg) AS n FROM g)
SELECT book_id, seg AS canonical_name, n AS chapters, (SELECT count(*) FROM c WHERE c.book_id = o.book_id AND c.seg = o.seg) AS scenes FROM o WHERE r = 1""")
def q_resolve_books(spark, sf_dir):
    """Chapter entities resolved to book entities one after the other."""
    found = resolution.resolve_books(chapters(spark, sf_dir).withColumn("order", F.col("chapter_id").cast("int")), by_name)
    return found.select("book_id", "canonical_name", F.size("chapter_ids").cast("long").alias("chapters"), F.size("scene_ids").cast("long").alias("scenes"))


def same_letter(pairs):
    """All pairs are one entity: what is shortlisted is merged."""
    return {"decisions": [{"left_entity_id": a, "right_entity_id": b, "decision": "SAME_ENTITY"} for a, b in pairs]}


@query(f"WITH {_C} SELECT book_id, chapter_id, count(*) AS mentions, count(DISTINCT seg) AS aliases FROM c GROUP BY 1, 2")
def q_reconcile_chapters(spark, sf_dir):
    """Clusters of a chapter compared in pairs and merged: five names are fewer than the shortlist's six, so one entity is left."""
    found = chapters(spark, sf_dir, same_letter)
    return found.select("book_id", "chapter_id", F.size("mention_ids").cast("long").alias("mentions"), F.size("aliases").cast("long").alias("aliases"))


_FLAT = "CASE event_type WHEN 'click' THEN 'known' WHEN 'view' THEN 'new' WHEN 'purchase' THEN 'off' ELSE 'bad' END"


@query(f"""WITH r AS (SELECT event_id, user_id, {_FLAT} AS kind FROM events), x AS (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('b:person:name ' || user_id)) AS h FROM r)
SELECT 'm' || event_id AS mention_id, CASE kind WHEN 'known' THEN 'e' || (user_id % 20) WHEN 'new' THEN 'entity:' || {_UUID} END AS entity_id, CAST(NULL AS VARCHAR) AS problem FROM x WHERE kind <> 'bad' AND NOT (kind = 'known' AND user_id % 20 >= 15)
UNION ALL SELECT 'm' || event_id, NULL, CASE WHEN kind = 'bad' THEN 'choice' ELSE 'unknown entity' END FROM x WHERE kind = 'bad' OR (kind = 'known' AND user_id % 20 >= 15)""")
def q_flat_resolution(spark, sf_dir):
    """Events as replies about mentions: a known entity, a new one, none, or two choices at once."""
    e = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") == "click", "known").when(F.col("event_type") == "view", "new").when(F.col("event_type") == "purchase", "off").otherwise("bad"))
    mention, user = F.concat(F.lit("m"), "event_id"), F.col("user_id").cast("string")
    replies = e.select(F.lit("b").alias("book_id"), mention.alias("mention_id"), F.when(F.col("kind").isin("known"), F.concat(F.lit("e"), (F.col("user_id") % 20).cast("string"))).alias("entity_id"), F.when(F.col("kind").isin("new", "bad"), F.concat(F.lit("Name  "), user)).alias("new_name"), F.lit("person").alias("new_type"), F.lit(None).cast("array<string>").alias("new_aliases"), F.col("kind").isin("off", "bad").alias("unresolved"))
    known = spark.range(15).select(F.lit("b").alias("book_id"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"))
    links, _, faults = resolution.flat_resolutions(replies, e.select(F.lit("b").alias("book_id"), mention.alias("id")), known)
    return links.select("mention_id", "entity_id", F.lit(None).cast("string").alias("problem")).unionByName(faults.select("mention_id", F.lit(None).cast("string").alias("entity_id"), "problem"))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 700)) AS a FROM documents)
SELECT doc_id AS book_id, CAST(a AS INTEGER) AS start_offset, CAST(length(substr(text, a + 1, 700)) AS INTEGER) AS n, a % 1400 = 0 AS fits FROM s""")
def q_portions(spark, sf_dir):
    """Pieces of 700 characters as chunks of a scene that begins at 5; every second piece has another text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "text").where(F.length("text") > 0)
    scenes = d.select("book_id", F.lit("s").alias("id"), F.lit(5).alias("start_char"), "text")
    k = d.select("book_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(700))).alias("a"))
    piece = F.substring("text", F.col("a") + 1, F.lit(700))
    chunks = k.select("book_id", F.lit("s").alias("scene_id"), F.col("a").cast("string").alias("id"), (F.col("a") + 5).alias("start_char"), F.when(F.col("a") % 1400 == 0, piece).otherwise(F.regexp_replace(piece, "(?s).", "\u0001")).alias("text"))
    return resolution.portions(chunks, scenes).select("book_id", "start_offset", F.length("text").alias("n"), "fits")
