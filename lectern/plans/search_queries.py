"""Queries over vectors, intervals, searches, reviews, pages and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import intervals, lexical, search, sessions, vectors
from lectern.plans.registry import query, table
from lectern.plans.text_queries import _BM25, _PARAS, documents, paragraphs
from lectern.sources import html

_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_SCORED = f"{_Q}, s AS (SELECT vec_id, round((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)) / 2, 6) AS score FROM embeddings, q)"


def probe(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding]


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query(f"WITH {_SCORED} SELECT vec_id, score FROM s")
def q_vector_scan(spark, sf_dir):
    """Similarity of every vector with the first."""
    q = F.array(*[F.lit(x) for x in probe(spark, sf_dir)])
    return embeddings(spark, sf_dir).where(V.valid(F.col("embedding"))).select("vec_id", F.round(V.similarity(F.col("embedding"), q), 6).alias("score"))


@query(f"WITH {_SCORED} SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def q_vector_topk(spark, sf_dir):
    """A top-20 report by similarity with the first vector."""
    best, _ = vectors.scan(embeddings(spark, sf_dir), probe(spark, sf_dir), "vec_id", "embedding", 20)
    return best.select("vec_id", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("rank"))


@query(f"WITH {_SCORED} SELECT vec_id, score FROM s WHERE NOT (vec_id * 10 < 37 AND vec_id * 10 + 15 > 0) QUALIFY row_number() OVER (ORDER BY score DESC, vec_id) <= 15")
def q_similar_excluding_overlap(spark, sf_dir):
    """The 15 chunks most similar to the first that do not overlap the span 0..37; chunk i spans 10 i .. 10 i + 15."""
    rows = embeddings(spark, sf_dir).withColumns({"start_char": F.col("vec_id") * 10, "end_char": F.col("vec_id") * 10 + 15})
    return vectors.similar_outside(rows, probe(spark, sf_dir), "vec_id", "embedding", 0, 37, 15).select("vec_id", F.round("score", 6).alias("score"))


@query("WITH p AS (SELECT label, vec_id % 7 + 1 AS w, unnest(range(len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(w * x) / sum(w), 6) AS value FROM p GROUP BY 1, 2")
def q_scene_centroids(spark, sf_dir):
    return vectors.centroids(embeddings(spark, sf_dir), "label", "embedding", F.col("vec_id") % 7 + 1).withColumn("value", F.round("value", 6))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.label <> b.label)
SELECT src, dst, round(s, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 3""")
def q_vector_pair_shortlist(spark, sf_dir):
    """Every vector's three nearest of other labels."""
    return vectors.neighbours(embeddings(spark, sf_dir), "vec_id", "embedding", "label", 3).select("src", "dst", F.round("score", 6).alias("score"))


@query(_BM25 + f""", {_SCORED.replace("s AS", "sv AS")},
a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(b.score, 6) DESC, doc_id) AS r FROM b QUALIFY r <= 100),
c AS (SELECT vec_id AS id, row_number() OVER (ORDER BY sv.score DESC, vec_id) AS r FROM sv QUALIFY r <= 100),
u AS (SELECT id, r FROM a UNION ALL SELECT id, r FROM c)
SELECT id, count(*) AS channels, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM u GROUP BY 1""")
def q_rrf_two_channels(spark, sf_dir):
    """The best hundred of a word and a vector channel (limits of the channels), fused."""
    a, _ = lexical.top(lexical.bm25(documents(spark, sf_dir), "doc_id", ["the", "with"]).withColumn("score", F.round("score", 6)), "doc_id", 100)
    q = F.array(*[F.lit(x) for x in probe(spark, sf_dir)])
    b = embeddings(spark, sf_dir).select("vec_id", F.round(V.similarity(F.col("embedding"), q), 6).alias("score"))
    b, _ = lexical.top(b, "vec_id", 100)
    w = Window.orderBy(F.desc("score"), "id")  # 100 rows each
    rank = lambda df, key, name: df.select(F.col(key).alias("id"), "score").select("id", F.row_number().over(w).alias("rank"), F.lit(name).alias("channel"))
    return search.fuse(rank(a, "doc_id", "words").unionByName(rank(b, "vec_id", "semantic")), ["id"]).select("id", F.size("scores").cast("long").alias("channels"), F.round("score", 9).alias("score"))


def event_hits(spark, sf_dir):
    """Events as hits: the user is the search, the type the channel, ranked by value; id is event_id modulo 40."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("search_id"), F.col("event_type").alias("channel"), (F.col("event_id") % 40).alias("id"), "value")
    best = e.groupBy("search_id", "channel", "id").agg(F.max("value").alias("value"))
    return search.ranked(best, ["search_id", "channel"], F.desc("value"), "id")


@query("""WITH RECURSIVE b AS (SELECT user_id AS search_id, event_type AS channel, event_id % 40 AS id, max(value) AS value FROM events GROUP BY 1, 2, 3),
r AS (SELECT search_id, channel, id, row_number() OVER (PARTITION BY search_id, channel ORDER BY value DESC, id) AS rank FROM b),
c AS (SELECT search_id, channel, list(id ORDER BY rank) AS ids FROM r GROUP BY 1, 2),
l AS (SELECT search_id, list(ids ORDER BY channel) AS lines, (SELECT count(DISTINCT id) FROM r WHERE r.search_id = c.search_id) AS total FROM c GROUP BY 1),
t AS (SELECT search_id, lines, total, 0 AS step, CAST([] AS BIGINT[]) AS taken FROM l
UNION ALL SELECT search_id, lines, total, step + 1, CASE WHEN new IS NULL THEN taken ELSE list_append(taken, new) END FROM (SELECT *, list_filter(lines[step % len(lines) + 1], lambda x: NOT list_contains(taken, x))[1] AS new FROM t WHERE len(taken) < total)),
o AS (SELECT search_id, unnest(taken) AS id, CAST(unnest(range(len(taken))) AS BIGINT) AS ord FROM t WHERE len(taken) = total),
s AS (SELECT search_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM r GROUP BY 1, 2)
SELECT search_id, id, ord, score FROM o JOIN s USING (search_id, id)""")
def q_round_robin(spark, sf_dir):
    fused = search.fuse(event_hits(spark, sf_dir), ["search_id", "id"])
    return search.round_robin(fused).select("search_id", "id", "ord", F.round("score", 9).alias("score"))


@query("""WITH b AS (SELECT user_id AS search_id, event_type AS channel, event_id % 40 AS id, max(value) AS value FROM events GROUP BY 1, 2, 3),
r AS (SELECT search_id, id, row_number() OVER (PARTITION BY search_id, channel ORDER BY value DESC, id) AS rank FROM b)
SELECT search_id, id, count(*) AS channels, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM r GROUP BY 1, 2""")
def q_fuse_channels(spark, sf_dir):
    return search.fuse(event_hits(spark, sf_dir), ["search_id", "id"]).select("search_id", "id", F.size("scores").cast("long").alias("channels"), F.round("score", 9).alias("score"))


@query("""WITH h AS (SELECT user_id AS search_id, event_type AS channel, event_id % 300 AS s, event_id % 300 + 20 + event_id % 90 AS e, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rank FROM events),
g(a, b) AS (VALUES (0, 80), (80, 150), (200, 330)),
c AS (SELECT search_id, channel, greatest(s, a) AS start_char, least(e, b) AS end_char, min(rank) AS rank FROM h JOIN g ON s < b AND e > a GROUP BY 1, 2, 3, 4)
SELECT search_id, start_char, end_char, start_char || ':' || end_char AS id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM c GROUP BY 1, 2, 3""")
def q_fuse_clip_dedup(spark, sf_dir):
    """Hits cut to three ranges and joined by place."""
    e = table(spark, sf_dir, "events")
    s = F.col("event_id") % 300
    h = e.select(F.col("user_id").alias("search_id"), F.col("event_type").alias("channel"), s.alias("start_char"), (s + 20 + F.col("event_id") % 90).alias("end_char"), F.col("event_id").alias("id"), F.lit("chunk").alias("origin"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("anchor_start"), F.lit(None).cast("long").alias("anchor_end"))
    ranges = spark.createDataFrame([(0, 80), (80, 150), (200, 330)], "start_char long, end_char long")  # a stated scope
    found = search.candidates(search.ranked(h, ["search_id", "channel"], "id"), ranges)
    return found.select("search_id", "start_char", "end_char", "id", F.round("score", 9).alias("score"))


_IV = "iv AS (SELECT event_id, user_id, event_id * 3 AS s, event_id * 3 + 1 + event_id % 47 AS e, event_type FROM events)"


def event_ranges(spark, sf_dir):
    """Events as ranges of 1 to 47 places."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", (F.col("event_id") * 3).alias("start_char"), (F.col("event_id") * 3 + 1 + F.col("event_id") % 47).alias("end_char"))


@query(f"WITH {_IV} SELECT a.event_id AS click, b.event_id AS purchase FROM iv a JOIN iv b ON a.s < b.e AND a.e > b.s WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def q_overlap_join(spark, sf_dir):
    r = event_ranges(spark, sf_dir).withColumn("k", F.lit(0))
    pairs = intervals.overlap_join(r.where("event_type = 'click'"), r.where("event_type = 'purchase'"), ["k"], 64)
    return pairs.select(F.col("left_event_id").alias("click"), F.col("right_event_id").alias("purchase"))


@query(f"""WITH {_IV}, b AS (SELECT user_id, min(s) AS lo, max(e) AS hi FROM iv GROUP BY 1),
h AS (SELECT i.user_id, s, e, lo, hi FROM iv i JOIN b USING (user_id) WHERE event_type <> 'view' UNION ALL SELECT user_id, hi, hi, lo, hi FROM b),
g AS (SELECT user_id, greatest(lo, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS start_char, least(s, hi) AS end_char FROM h)
SELECT * FROM g WHERE start_char < end_char""")
def q_interval_subtract(spark, sf_dir):
    """A user's whole span without the ranges of what isn't a view."""
    r = event_ranges(spark, sf_dir)
    base = r.groupBy("user_id").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))
    return intervals.subtract(base, r.where("event_type <> 'view'"), ["user_id"])


@query(f"""WITH {_IV}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM m)
SELECT user_id, min(s) AS start_char, max(e) AS end_char, count(*) AS n_ranges FROM i GROUP BY user_id, island""")
def q_islands(spark, sf_dir):
    return intervals.merge(event_ranges(spark, sf_dir), ["user_id"])


@query(f"""WITH {_IV}, p AS (SELECT user_id, lag(e) OVER (PARTITION BY user_id ORDER BY s, e) AS previous_end, s AS start_char FROM iv)
SELECT user_id, previous_end, start_char, CASE WHEN previous_end < start_char THEN 'gap' ELSE 'overlap' END AS kind FROM p WHERE previous_end <> start_char""")
def q_tiling_violations(spark, sf_dir):
    return intervals.tiling_violations(event_ranges(spark, sf_dir), ["user_id"])


@query(f"""WITH {_IV}, p AS (SELECT event_id, s, e FROM iv WHERE event_type = 'click'), c AS (SELECT event_id, s, e FROM iv WHERE event_type = 'view')
SELECT p.event_id, c.event_id AS container FROM p JOIN c ON c.s <= p.s AND c.e >= p.e QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY c.e - c.s, c.s) = 1""")
def q_smallest_container(spark, sf_dir):
    r = event_ranges(spark, sf_dir).withColumn("k", F.lit(0))
    found = intervals.smallest_container(r.where("event_type = 'click'"), r.where("event_type = 'view'"), ["k"], "event_id", 64)
    return found.select(F.col("left_event_id").alias("event_id"), F.col("right_event_id").alias("container"))


@query(f"""WITH {_PARAS}, n AS (SELECT doc_id, length(text) AS n FROM documents), h(search_id, channel, a, b, score) AS (VALUES ('s1', 'words', 1, 3, 1.0::DOUBLE / 61), ('s2', 'semantic', 2, 5, 1.0::DOUBLE / 62), ('s1', 'semantic', 0, 1, 1.0::DOUBLE / 61))
SELECT search_id, n.doc_id AS book_id, l AS start_char, r AS end_char, channel, round(max(score), 9) AS score FROM n, h, paras p WHERE p.doc_id = n.doc_id AND CAST(floor(n * a / 10.0) AS BIGINT) < r AND CAST(floor(n * b / 10.0) AS BIGINT) > l GROUP BY 1, 2, 3, 4, 5""")
def q_project_passages(spark, sf_dir):
    """Hits of two searches in every document, projected to its paragraphs."""
    docs = documents(spark, sf_dir)
    chunks = paragraphs(docs).withColumnRenamed("doc_id", "book_id")
    n = docs.select(F.col("doc_id").alias("book_id"), F.length("text").cast("long").alias("n"))
    hits = n.select("book_id", F.explode(F.array(*[F.struct(F.lit(f"s{k}").alias("search_id"), F.lit(c).alias("channel"), (F.col("n") * a / 10).cast("long").alias("start_char"), (F.col("n") * b / 10).cast("long").alias("end_char"), F.lit(1.0 / (60 + k)).alias("score")) for k, c, a, b in ((1, "words", 1, 3), (2, "semantic", 2, 5), (1, "semantic", 0, 1))])).alias("h")).select("book_id", "h.*")
    return search.project(hits, chunks).withColumn("score", F.round("score", 9))


_STATUS = "CASE event_type WHEN 'purchase' THEN 'relevant' WHEN 'signup' THEN 'uncertain' WHEN 'error' THEN 'rejected' ELSE 'unreviewed' END"


def reviews(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "relevant").when(F.col("event_type") == "signup", "uncertain").when(F.col("event_type") == "error", "rejected").otherwise("unreviewed")
    return e.select(F.col("user_id").alias("search_id"), "event_id", status.alias("review_status"), "value")


@query(f"WITH r AS (SELECT user_id AS search_id, {_STATUS} AS st FROM events) SELECT search_id, " + ", ".join(f"CAST(sum(CASE WHEN st = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}" for s in search.STATUSES) + " FROM r GROUP BY 1")
def q_review_counts(spark, sf_dir):
    return search.review_counts(reviews(spark, sf_dir))


@query(f"""WITH i AS (SELECT event_id % 500 AS id, event_id % 4 AS search_no, {_STATUS} AS st, max(value) AS v FROM events GROUP BY 1, 2, 3)
SELECT id, CASE WHEN count(DISTINCT CASE WHEN st <> 'unreviewed' THEN st END) = 0 THEN 'unreviewed' WHEN count(DISTINCT CASE WHEN st <> 'unreviewed' THEN st END) = 1 THEN max(CASE WHEN st <> 'unreviewed' THEN st END) ELSE 'uncertain' END AS review_status, round(max(v), 6) AS score FROM i GROUP BY 1""")
def q_merge_searches(spark, sf_dir):
    """Events as items of four searches, merged by item."""
    r = reviews(spark, sf_dir).groupBy((F.col("event_id") % 500).alias("id"), (F.col("event_id") % 4).alias("search_no"), "review_status").agg(F.max("value").alias("v"))
    items = r.select("search_no", "id", "review_status", F.lit(False).alias("selected"), F.lit(False).alias("viewed"), F.create_map(F.lit("words"), F.col("v")).alias("scores"))
    return search.merge_searches(items).select("id", "review_status", F.round(F.col("scores")["words"], 6).alias("score"))


@query(f"""WITH o AS (SELECT user_id AS search_id, event_id, {_STATUS} AS st, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS ord FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY ord) AS n FROM o WHERE ord >= 3 AND st = 'unreviewed')
SELECT search_id, event_id, ord, CASE WHEN max(n) OVER (PARTITION BY search_id) > 5 THEN max(CASE WHEN n <= 5 THEN ord END) OVER (PARTITION BY search_id) + 1 END AS next_offset FROM f QUALIFY n <= 5""")
def q_paging_status(spark, sf_dir):
    """The page of five unreviewed items from offset 3 of each search."""
    w = Window.partitionBy("search_id").orderBy(F.desc("value"), "event_id")
    items = reviews(spark, sf_dir).withColumn("ord", (F.row_number().over(w) - 1).cast("long"))
    return search.page(items, 3, 5, "unreviewed").select("search_id", "event_id", "ord", "next_offset")


@query("SELECT user_id AS search_id, count(*) AS items, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS viewed, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS rejected, max(event_id) AS last FROM events GROUP BY 1")
def q_session_counters(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "rejected").otherwise("unreviewed")
    return sessions.counters(table(spark, sf_dir, "events").select(F.col("user_id").alias("search_id"), (F.col("event_type") == "view").alias("viewed"), status.alias("review_status"), F.col("event_id").alias("at")))


@query()
def q_html_blocks(spark, sf_dir):
    """Blocks of every page."""
    return html.blocks(table(spark, sf_dir, "pages"), "page_id").select("page_id", "pos", "type", "heading_level", F.length("text").alias("n_chars"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?s)<p[ >]')) AS n FROM pages WHERE regexp_matches(html, '<p[ >]')")
def q_html_paragraphs(spark, sf_dir):
    """How many paragraphs open in each page."""
    n = F.regexp_count("html", F.lit(r"<p[ >]"))
    return table(spark, sf_dir, "pages").select("page_id", n.cast("long").alias("n")).where("n > 0")


@query("SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'relevant' WHEN 0 THEN 'rejected' END, 'unreviewed') AS review_status, '0:' || least(120, length(text)) AS coordinates, substr(text, 1, 120) AS quote, sha256(text) AS text_hash FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1")
def q_export_rows(spark, sf_dir):
    """Rows for export: relevant documents with status, coordinates and quote."""
    l = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("relevant").alias("review_status"))
    t = F.col("text")
    return documents(spark, sf_dir).join(l, "doc_id").select("doc_id", "review_status", F.concat(F.lit("0:"), F.least(F.lit(120), F.length(t)).cast("string")).alias("coordinates"), F.substring(t, 1, 120).alias("quote"), T.content_hash(t).alias("text_hash"))
