
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import entities, prepare, related, search, structure
from lectern.plans.registry import query, table

#: Parts of one name that are paired in one place, about.
NAME_PARTS = 1000
_SCENES = "scenes AS (SELECT o_custkey AS book_id, o_orderkey AS id, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS scene_rank FROM orders)"


def scenes(spark, sf_dir):
    """Orders as scenes: the customer is the book, reading order by date and key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return o.withColumn("scene_rank", F.row_number().over(Window.partitionBy("book_id").orderBy("o_orderdate", "id")))


def mentions(spark, sf_dir):
    """Line items as mentions of suppliers in orders; returned ones are references."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("scene_id"), "l_linenumber", "l_returnflag")
    return l.withColumn("mention_id", F.col("l_linenumber")), l.where("l_returnflag = 'R'").withColumn("reference_id", F.col("l_linenumber"))


@query("""WITH m AS (SELECT l_suppkey AS entity_id, l_orderkey AS scene_id, count(DISTINCT l_linenumber) AS mention_count, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS reference_count FROM lineitem GROUP BY 1, 2) SELECT * FROM m""")
def q_presence(spark, sf_dir):
    return entities.presence(*mentions(spark, sf_dir))


@query("SELECT s_suppkey, s_name, count(DISTINCT l_orderkey) AS scene_count FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2")
def q_entity_catalog(spark, sf_dir):
    m, _ = mentions(spark, sf_dir)
    return entities.catalog(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name"), m).select(F.col("id").alias("s_suppkey"), "s_name", "scene_count")


@query("SELECT l_orderkey AS scene_id, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2")
def q_entities_intersection(spark, sf_dir):
    m, _ = mentions(spark, sf_dir)
    return entities.scenes_with(m, [1, 2])


@query("SELECT l_orderkey AS scene_id, count(DISTINCT l_suppkey) AS n, min(l_linenumber) AS anchor, min(struct_pack(a := l_linenumber, b := l_suppkey)).b AS anchor_entity FROM lineitem WHERE l_suppkey IN (1, 2, 3) GROUP BY 1")
def q_entities_union_anchor(spark, sf_dir):
    m, _ = mentions(spark, sf_dir)
    anchor = m.where("entity_id in (1, 2, 3)").groupBy("scene_id").agg(F.min("l_linenumber").alias("anchor"), F.min(F.struct("l_linenumber", "entity_id"))["entity_id"].alias("anchor_entity"))
    return entities.scenes_with(m, [1, 2, 3], every=False).join(anchor, "scene_id")


@query(f"WITH {_SCENES} SELECT book_id, id, scene_rank, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM scenes WINDOW w AS (PARTITION BY book_id ORDER BY scene_rank)")
def q_next_scene_chain(spark, sf_dir):
    return search.reading_chain(scenes(spark, sf_dir).drop("scene_rank"), "o_orderdate").select("book_id", "id", "scene_rank", "previous_id", "next_id")


@query(f"WITH {_SCENES}, a AS (SELECT s.* FROM scenes s JOIN orders o ON o.o_orderkey = s.id WHERE o_orderpriority = '1-URGENT') SELECT a.book_id, a.id AS anchor_id, s.id, s.scene_rank - a.scene_rank AS distance FROM a JOIN scenes s ON s.book_id = a.book_id AND s.scene_rank BETWEEN a.scene_rank - 2 AND a.scene_rank + 1 AND s.id <> a.id")
def q_neighbors(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("id"))
    return search.neighbours(scenes(spark, sf_dir), a, 2, 1).withColumn("distance", F.col("distance").cast("long"))


@query(f"WITH {_SCENES}, a AS (SELECT s.* FROM scenes s JOIN orders o ON o.o_orderkey = s.id WHERE o_orderpriority = '1-URGENT') SELECT s.book_id, s.id, min(abs(s.scene_rank - a.scene_rank)) AS distance FROM a JOIN scenes s ON s.book_id = a.book_id AND abs(s.scene_rank - a.scene_rank) <= 3 GROUP BY 1, 2")
def q_k_hop(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("id"))
    return search.within_hops(scenes(spark, sf_dir), a, 3).withColumn("distance", F.col("distance").cast("long"))


_TREE = "tree AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


def tree(spark, sf_dir):
    """Regions, nations and customers as sections of three levels."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    n = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent_id"))
    c = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("parent_id"))
    return r.union(n).union(c)


@query(f"WITH RECURSIVE {_TREE}, x AS (SELECT id AS root, id, 0 AS level FROM tree WHERE parent_id IS NULL UNION ALL SELECT x.root, t.id, x.level + 1 FROM x JOIN tree t ON t.parent_id = x.id) SELECT * FROM x")
def q_section_closure(spark, sf_dir):
    t = tree(spark, sf_dir)
    return structure.closure(t, t.where("parent_id is null"), depth=3)


@query("SELECT c_custkey, 'n' || c_nationkey AS up1, 'r' || n_regionkey AS up2, 'r' || n_regionkey AS up5 FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q_ancestor_at_level(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("r"))
    c = table(spark, sf_dir, "customer").join(n, "c_nationkey")
    path = F.array("r", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", *[structure.ancestor(path, k).alias(f"up{k}") for k in (1, 2, 5)])


_LINKS = "o AS (SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS k FROM lineitem), links AS (SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS a, greatest(a.l_suppkey, b.l_suppkey) AS b FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND b.k = a.k + 1 AND a.l_suppkey <> b.l_suppkey WHERE a.l_quantity > 49 AND a.l_returnflag = 'R')"


def links(spark, sf_dir, every=False):
    """Suppliers of neighbouring line items of an order; only those of a large returned first item unless ``every``."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    pairs = l.withColumn("b", F.lead("l_suppkey").over(w)).where("l_suppkey <> b")
    if not every:
        pairs = pairs.where("l_quantity > 49 and l_returnflag = 'R'")
    return pairs.select(F.least("l_suppkey", "b").alias("a"), F.greatest("l_suppkey", "b").alias("b")).distinct()


def degrees(pairs):
    e = search.both_ways(pairs, "a", "b")
    return e.groupBy(F.col("a").alias("source")).agg(F.count("*").alias("degree"), F.min("b").alias("first"))


@query(f"WITH {_LINKS}, u AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) SELECT a AS source, count(*) AS degree, min(b) AS first FROM u GROUP BY 1")
def q_undirected_links(spark, sf_dir):
    return degrees(links(spark, sf_dir))


_EVERY_LINK = "o AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS k FROM lineitem), links AS (SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS a, greatest(a.l_suppkey, b.l_suppkey) AS b FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND b.k = a.k + 1 AND a.l_suppkey <> b.l_suppkey)"


@query(f"WITH {_EVERY_LINK}, u AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) SELECT a AS source, count(*) AS degree, min(b) AS first FROM u GROUP BY 1")
def q_undirected_links_full(spark, sf_dir):
    """The links of all neighbouring line items."""
    return degrees(links(spark, sf_dir, every=True))


@query(f"WITH RECURSIVE {_LINKS}, u AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), x AS (SELECT a AS node, a AS reach FROM u UNION SELECT x.node, u.b FROM x JOIN u ON u.a = x.reach) SELECT node, min(reach) AS root FROM x GROUP BY 1")
def q_connected_components(spark, sf_dir):
    return entities.connected(links(spark, sf_dir))


@query()
def q_connected_components_full(spark, sf_dir):
    """Components of the links of all neighbouring line items; the recursive SQL makes node x reach rows, so none is given."""
    return entities.connected(links(spark, sf_dir, every=True))


@query()
def q_conservative_unions(spark, sf_dir):
    """Suppliers of a nation joined only where every pair of a group is linked."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("book_id"), F.col("s_suppkey").cast("long").alias("id"))
    return entities.conservative_groups(lambda a, b: (b - a) % 3 != 0, s)


@query("""WITH t AS (SELECT p_partkey, p_brand, list_distinct(regexp_extract_all(lower(p_name), '[\\pL\\pN_]+')) AS w FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w)))), 6) AS score FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w)))) >= 0.5""")
def q_name_jaccard(spark, sf_dir):
    """Parts of one brand whose names share half of their words: each two names are compared once, however many parts have them, on a shared word."""
    t = table(spark, sf_dir, "part").select("p_brand", F.array_sort(F.array_distinct(T.tokens(F.col("p_name")))).alias("w"), "p_partkey")
    n = t.groupBy("p_brand", "w").agg(F.count("*").alias("n"))
    word = n.select("p_brand", "w", "n", F.explode("w").alias("word"))
    both = word.select("p_brand", "word", F.col("w").alias("wa"), "n").join(word.select("p_brand", "word", F.col("w").alias("wb")), ["p_brand", "word"])
    near = both.where(F.array_min(F.array_intersect("wa", "wb")) == F.col("word")).withColumn("score", T.jaccard(F.col("wa"), F.col("wb"))).where("score >= 0.5")
    # parts of a name that many have are dealt, so that no task has all their pairs
    near = near.select("p_brand", "wa", "wb", F.round("score", 6).alias("score"), F.ceil(F.col("n") / NAME_PARTS).alias("lots"))
    a = near.join(t.select("p_brand", F.col("w").alias("wa"), F.col("p_partkey").alias("a")), ["p_brand", "wa"]).select("p_brand", "wb", "a", "score", F.xxhash64("wa", F.pmod(F.xxhash64("a"), F.col("lots"))).alias("lot"))
    b = near.select("p_brand", "wb", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1), lambda i: F.xxhash64("wa", i))).alias("lot")).distinct()
    b = b.join(t.select("p_brand", F.col("w").alias("wb"), F.col("p_partkey").alias("b")), ["p_brand", "wb"])
    return a.join(b, ["p_brand", "wb", "lot"]).where("a < b").select("a", "b", "score")


@query()
def q_name_similarity(spark, sf_dir):
    """Suppliers found by a name with a slip."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.lit(1).alias("scene_count"))
    return entities.name_match(s, "Suplier#000000003")


@query("""WITH p AS (SELECT p_brand, p_name, len(regexp_extract_all(lower(p_name), '[\\pL\\pN_]+')) AS w, length(p_name) AS n FROM part)
SELECT p_brand, p_name AS name FROM p QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY w DESC, n, p_name) = 1""")
def q_canonical_name(spark, sf_dir):
    keyed = F.struct((-F.size(T.tokens(F.col("p_name")))).alias("w"), F.length("p_name").alias("n"), F.col("p_name").alias("name"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min(keyed).alias("k")).select("p_brand", F.col("k.name").alias("name"))


@query("""WITH h AS (SELECT o_orderkey, sha256(o_orderstatus || ':' || o_custkey) AS had, sha256(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END || ':' || o_custkey) AS now FROM orders)
SELECT o_orderkey AS chapter_id, CASE WHEN o_orderkey % 7 = 0 THEN 'gone' WHEN had <> now THEN 'stale' ELSE 'current' END AS state FROM h""")
def q_stale_layers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chapter_id"), "o_orderstatus", "o_custkey")
    layers = o.select("chapter_id", F.sha2(F.concat_ws(":", "o_orderstatus", "o_custkey"), 256).alias("input_hash"))
    now = o.where("chapter_id % 7 <> 0").select("chapter_id", F.sha2(F.concat_ws(":", F.when(F.col("chapter_id") % 5 == 0, "x").otherwise(F.col("o_orderstatus")), "o_custkey"), 256).alias("input_hash"))
    return structure.stale(layers, now)


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS scenes, count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) AS ready, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN o_orderkey END) AS covered FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def q_coverage_status(spark, sf_dir):
    """Scenes, ready ones and covered ones for each book; coverage is reduced to scenes before the join."""
    covered = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "F").alias("ready"))
    return prepare.coverage(o, covered).withColumnRenamed("book_id", "o_custkey")


@query(f"""WITH {_SCENES}, a AS (SELECT s.* FROM scenes s JOIN orders o ON o.o_orderkey = s.id WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT 'composition' AS channel, s.id, abs(s.scene_rank - a.scene_rank) AS r FROM a JOIN scenes s ON s.book_id = a.book_id AND abs(s.scene_rank - a.scene_rank) BETWEEN 1 AND 2
UNION ALL SELECT 'character', l_orderkey, min(l_linenumber) FROM lineitem WHERE l_suppkey IN (1, 2, 3) GROUP BY 1, 2),
b AS (SELECT id, channel, min(r) AS r FROM c GROUP BY 1, 2)
SELECT id, count(*) AS channels, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM b GROUP BY 1""")
def q_expand_channels(spark, sf_dir):
    """Two expansion channels fused by id."""
    a = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("id"))
    near = search.neighbours(scenes(spark, sf_dir), a, 2, 2).select("id", F.abs("distance").alias("rank"), F.lit("composition").alias("channel"))
    m, _ = mentions(spark, sf_dir)
    who = m.where("entity_id in (1, 2, 3)").groupBy(F.col("scene_id").alias("id")).agg(F.min("l_linenumber").alias("rank")).withColumn("channel", F.lit("character"))
    return search.fuse(near.unionByName(who), ["id"]).select("id", F.size("scores").cast("long").alias("channels"), F.round("score", 9).alias("score"))


@query("""WITH r AS (SELECT user_id, event_type, event_id - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g, event_id FROM events)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM r) GROUP BY user_id, event_type, run""")
def q_runs(spark, sf_dir):
    """Maximal runs of one event type among the events of a user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    r = structure.runs(e, ["user_id"], "k", "event_type")
    ids = e.select("user_id", "k", "event_id")
    first = ids.select("user_id", F.col("k").alias("first"), F.col("event_id").alias("first_id"))
    last = ids.select("user_id", F.col("k").alias("last"), F.col("event_id").alias("last_id"))
    return r.join(first, ["user_id", "first"]).join(last, ["user_id", "last"]).select("user_id", "event_type", F.col("first_id").alias("first"), F.col("last_id").alias("last"), "n")


_FRAGS = """s AS (SELECT o_custkey AS book_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, o_orderpriority AS title FROM orders), frag AS (SELECT book_id, r AS fragment, r * 100 + 10 AS a, r * 100 + 120 AS b FROM s WHERE r % 3 = 0),
links AS (SELECT x.book_id, x.id AS source_id, y.id AS target_id, (['retells', 'parallels', 'causes'])[CAST(x.id % 3 AS INTEGER) + 1] AS type, CASE WHEN x.id % 2 = 0 THEN 'suggestive' ELSE 'explicit' END AS basis, CASE WHEN x.id % 4 = 0 THEN 'why' END AS reason, x.id AS xid, y.id AS yid FROM s x JOIN s y ON x.book_id = y.book_id AND y.r = x.r + 2)"""


def fragments(spark, sf_dir):
    """(scenes, fragments, links): scenes of 100 characters each, every third a fragment that reaches into the next, links two scenes on."""
    w = Window.partitionBy("book_id").orderBy("id")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    s = s.withColumn("r", F.row_number().over(w) - 1).withColumns({"start_char": (F.col("r") * 100).cast("long"), "end_char": (F.col("r") * 100 + 100).cast("long"), "text_hash": F.col("id") % 11})
    frag = s.where("r % 3 = 0").select("book_id", F.col("r").cast("long").alias("fragment"), (F.col("start_char") + 10).alias("start_char"), (F.col("start_char") + 120).alias("end_char"))
    to = s.select("book_id", (F.col("r") - 2).alias("r"), F.col("id").alias("target_id"), F.col("text_hash").alias("target_hash"))
    kind = F.element_at(F.array(F.lit("retells"), F.lit("parallels"), F.lit("causes")), (F.col("source_id") % 3 + 1).cast("int"))
    l = s.select("book_id", "r", F.col("id").alias("source_id"), F.col("text_hash").alias("source_hash")).join(to, ["book_id", "r"])
    l = l.withColumns({"type": kind, "basis": F.when(F.col("source_id") % 2 == 0, "suggestive").otherwise("explicit"), "reason": F.when(F.col("source_id") % 4 == 0, "why")})
    return s, frag, l


_PATH = "CASE type WHEN 'retells' THEN 'пересказ того же события' WHEN 'parallels' THEN 'параллель' ELSE 'связь по причине' END || {} || CASE WHEN basis = 'suggestive' THEN ' (гипотеза)' ELSE '' END || ': «' || {} || '»' || CASE WHEN reason IS NOT NULL THEN ' — ' || reason ELSE '' END"


@query(f"""WITH {_FRAGS}, ways AS (SELECT book_id, source_id, target_id, type, basis, reason, xid, yid FROM links UNION ALL SELECT book_id, target_id, source_id, type, basis, reason, xid, yid FROM links),
hit AS (SELECT DISTINCT f.book_id, fragment, o.id, o.r * 100 AS start_char, {_PATH.format("' между сценами'", "o.title")} AS path FROM frag f JOIN s ON s.book_id = f.book_id AND s.r * 100 < b AND s.r * 100 + 100 > a JOIN ways ON ways.book_id = s.book_id AND source_id = s.id JOIN s o ON o.book_id = f.book_id AND o.id = target_id WHERE xid % 5 <> 0)
SELECT book_id, fragment, CAST(id AS VARCHAR) AS id, start_char, path, CAST(row_number() OVER (PARTITION BY book_id, fragment ORDER BY start_char, id, path) AS INTEGER) AS rank FROM hit""")
def q_linked_scenes(spark, sf_dir):
    """Scenes linked to those that fragments overlap; links of every fifth source are of another version."""
    s, frag, l = fragments(spark, sf_dir)
    old = l.withColumn("source_hash", F.when(F.col("source_id") % 5 == 0, -1).otherwise(F.col("source_hash")))
    return related.linked_scenes(frag, s, old).select("book_id", "fragment", "id", "start_char", "path", "rank")


@query(f"""WITH {_FRAGS}, ways AS (SELECT book_id, source_id, target_id, type, basis, reason FROM links UNION ALL SELECT book_id, target_id, source_id, type, basis, reason FROM links),
hit AS (SELECT DISTINCT f.book_id, fragment, o.id, o.r * 100 + 30 AS start_char, {_PATH.format("''", "'g' || o.id")} AS path FROM frag f JOIN s ON s.book_id = f.book_id AND s.r * 100 + 50 < b AND s.r * 100 + 55 > a JOIN ways ON ways.book_id = s.book_id AND source_id = s.id JOIN s o ON o.book_id = f.book_id AND o.id = target_id)
SELECT book_id, fragment, 'k' || id AS id, start_char, path, CAST(row_number() OVER (PARTITION BY book_id, fragment ORDER BY start_char, 'k' || id, path) AS INTEGER) AS rank FROM hit""")
def q_linked_events(spark, sf_dir):
    """Chunks with an event linked to one that a fragment overlaps; each scene has one event and a chunk around it."""
    s, frag, l = fragments(spark, sf_dir)
    events = s.select("book_id", "id", (F.col("start_char") + 50).alias("start_char"), (F.col("start_char") + 55).alias("end_char"), F.concat(F.lit("g"), "id").alias("gist"))
    chunks = s.select("book_id", F.concat(F.lit("k"), "id").alias("id"), (F.col("start_char") + 30).alias("start_char"), (F.col("start_char") + 70).alias("end_char"))
    return related.linked_events(frag, events, l.select("book_id", "source_id", "target_id", "type", "basis", "reason"), chunks).select("book_id", "fragment", "id", "start_char", "path", "rank")


@query(f"""WITH e AS (SELECT label AS book_id, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings),
p AS (SELECT x.book_id, x.r AS fragment, y.id, round((1 + list_cosine_similarity(x.v, y.v)) / 2, 9) AS s, y.r FROM e x JOIN e y ON x.book_id = y.book_id AND abs(x.r - y.r) > 1 WHERE x.r % 4 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id, fragment ORDER BY s DESC, CAST(id AS VARCHAR)) AS rank FROM p)
SELECT CAST(book_id AS BIGINT) AS book_id, fragment, CAST(id AS VARCHAR) AS id, CAST(rank AS INTEGER) AS nth, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM k WHERE rank <= 3""")
def q_related_fragments(spark, sf_dir):
    """Chunks most similar to those that contain fragments, fused into what is related; neighbours overlap by half."""
    w = Window.partitionBy("book_id").orderBy("id")
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("book_id"), F.col("vec_id").alias("id"), "embedding", F.lit("m").alias("embedding_model"))
    e = e.withColumn("r", (F.row_number().over(w) - 1).cast("long")).withColumns({"start_char": F.col("r") * 100, "end_char": F.col("r") * 100 + 150}).withColumn("id", F.col("id").cast("string"))
    frag = e.where("r % 4 = 0").select("book_id", F.col("r").alias("fragment"), (F.col("start_char") + 60).alias("start_char"), (F.col("start_char") + 90).alias("end_char"))
    found = related.related(related.similar_chunks(frag, e, 3))
    return found.select("book_id", "fragment", "id", "nth", F.round("score", 9).alias("score"))
