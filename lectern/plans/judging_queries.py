"""Queries over judging, review, turns, presentation and narrative; events as replies and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import judging, narrative, presentation
from lectern.plans.registry import query, table

_CAND = "c AS (SELECT user_id AS search_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord, CASE event_id % 5 WHEN 0 THEN 'relevant' WHEN 1 THEN 'rejected' ELSE 'unreviewed' END AS review_status FROM events)"


def candidates(spark, sf_dir):
    """Events as candidates of their user's search, some of them reviewed."""
    from pyspark.sql import Window

    k = F.col("event_id") % 5
    status = F.when(k == 0, "relevant").when(k == 1, "rejected").otherwise("unreviewed")
    ord_ = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("search_id"), F.col("event_id").alias("id"), ord_.alias("ord"), status.alias("review_status"), "value")


@query("""SELECT event_id, array_to_string(list_sort(list_distinct(['discourse', event_type] || CASE WHEN event_id % 2 = 0 THEN ['character', 'chronotope', 'soft_character'] ELSE [] END || CASE WHEN event_id % 3 = 0 THEN ['causal', 'parallel', 'prefiguring', 'retelling'] ELSE [] END)), ',') AS channels FROM events""")
def q_effective_channels(spark, sf_dir):
    """Channels asked for by events, with entities ready for every second and links for every third."""
    e = table(spark, sf_dir, "events")
    found = judging.effective_channels(F.array("event_type"), F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0)
    return e.select("event_id", F.array_join(found, ",").alias("channels"))


@query(f"WITH {_CAND} SELECT search_id, id, CAST(row_number() OVER (PARTITION BY search_id ORDER BY ord) AS INTEGER) AS nth FROM c WHERE review_status = 'relevant' QUALIFY nth <= 10")
def q_expansion_anchors(spark, sf_dir):
    """The first ten relevant candidates of every search."""
    return judging.anchors(candidates(spark, sf_dir), "relevant").select("search_id", "id", "nth")


@query(f"WITH {_CAND} SELECT search_id, id, CAST((row_number() OVER (PARTITION BY search_id ORDER BY ord) - 1) // 10 AS INTEGER) AS batch FROM c WHERE review_status = 'unreviewed' QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY ord) <= 120")
def q_judge_batches(spark, sf_dir):
    """The first 120 unreviewed candidates of every search (the limit of a step) in batches of ten."""
    return judging.batches(candidates(spark, sf_dir), 10, 120).select("search_id", "id", "batch")


@query(f"""WITH {_CAND}, b AS (SELECT *, CAST((row_number() OVER (PARTITION BY search_id ORDER BY ord) - 1) // 10 AS INTEGER) AS batch FROM c WHERE review_status = 'unreviewed'),
g AS (SELECT search_id, batch, id % 4 AS scene_id, min(ord) AS f, count(*) AS n, min(id) AS first_id FROM b GROUP BY 1, 2, 3)
SELECT search_id, batch, scene_id, n, first_id, CAST(row_number() OVER (PARTITION BY search_id, batch ORDER BY f) - 1 AS INTEGER) AS nth FROM g""")
def q_judge_scenes(spark, sf_dir):
    """Candidates of each batch grouped by scene, scenes by their first candidate."""
    c = judging.batches(candidates(spark, sf_dir)).select("search_id", "batch", "ord", "id", F.lit("t").alias("text"), F.lit("s").alias("section"))
    context = c.select("search_id", "id", (F.col("id") % 4).alias("scene_id"), F.lit("a").alias("scene_title"), F.lit("b").alias("scene_summary"), F.lit(None).cast("string").alias("previous_tail"), F.lit("n").alias("next_head"))
    found = judging.by_scene(c, context)
    return found.select("search_id", "batch", "scene_id", F.size("candidates").cast("long").alias("n"), F.element_at("candidates", 1)["id"].alias("first_id"), "nth")


_REPLY = "r AS (SELECT user_id AS search_id, event_id // 3 * 3 AS id, CAST(event_id % 3 AS INTEGER) AS attempt, event_id AS seq, CASE event_type WHEN 'click' THEN 'relevant' WHEN 'view' THEN 'irrelevant' WHEN 'purchase' THEN 'partial' ELSE 'what' END AS verdict FROM events)"


@query(f"""WITH {_REPLY}, c AS (SELECT DISTINCT search_id, id FROM r), g AS (SELECT * FROM r WHERE verdict <> 'what' QUALIFY row_number() OVER (PARTITION BY search_id, id ORDER BY attempt, seq) = 1)
SELECT c.search_id, count(*) AS total, count(g.id) AS judged, count(*) - count(g.id) AS open, count(CASE WHEN verdict = 'irrelevant' THEN 1 END) AS rejected, count(CASE WHEN attempt > 0 THEN 1 END) AS asked_again FROM c LEFT JOIN g ON g.search_id = c.search_id AND g.id = c.id GROUP BY 1""")
def q_judge_verdicts(spark, sf_dir):
    """Events as replies in up to three attempts: the first valid one counts; how many of each search are decided."""
    e = table(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type") == "click", "relevant").when(F.col("event_type") == "view", "irrelevant").when(F.col("event_type") == "purchase", "partial").otherwise("what")
    r = e.select(F.col("user_id").alias("search_id"), (F.floor(F.col("event_id") / 3) * 3).alias("id"), (F.col("event_id") % 3).cast("int").alias("attempt"), F.col("event_id").alias("seq"), verdict.alias("verdict"), F.lit(" ").alias("reason"), F.lit(None).cast("string").alias("evidence"))
    good, report = judging.verdicts(r.select("search_id", "id").distinct(), r)
    more = good.groupBy("search_id").agg(F.count(F.when(F.col("status") == "rejected", 1)).alias("rejected"), F.count(F.when(F.col("attempt") > 0, 1)).alias("asked_again"))
    return report.join(more, "search_id", "left").select("search_id", "total", "judged", "open", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("rejected", "asked_again")])


@query(f"""WITH {_CAND} SELECT search_id, id, CASE id % 4 WHEN 0 THEN 'relevant' WHEN 1 THEN 'rejected' ELSE review_status END AS review_status, (id % 4 <> 1) AS selected, CASE WHEN id % 4 IN (0, 1) THEN 2 ELSE 1 END AS entries,
CASE id % 4 WHEN 2 THEN 'status' WHEN 3 THEN 'reason' END AS problem FROM c""")
def q_review_candidate(spark, sf_dir):
    """A person's decision on every candidate; half of them are refused for a wrong state or no reason."""
    c = candidates(spark, sf_dir)
    entry = F.array(F.struct(F.lit("unreviewed").alias("status"), F.lit("x").alias("reason"), F.lit("0").alias("at")))
    full = c.select("search_id", "id", "review_status", F.lit("said").alias("reason"), F.lit(True).alias("selected"), entry.alias("review_history"))
    k = F.col("id") % 4
    d = c.select("search_id", "id", F.when(k == 0, "relevant").when(k == 2, "odd").otherwise("rejected").alias("status"), F.when(k == 3, " ").otherwise("because").alias("reason"), F.lit("1").alias("at"))
    out, faults = judging.review(full, d)
    return out.join(faults, ["search_id", "id"], "left").select("search_id", "id", "review_status", "selected", F.size("review_history").alias("entries"), "problem")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'решение исследователя' WHEN 1 THEN 'решение исследователя (было: ' || event_type || ')' ELSE 'решение исследователя (было: ' || event_type || ')' END AS reason FROM events""")
def q_manual_reason(spark, sf_dir):
    """Reasons of manual decisions after none, after the model's, and after an earlier manual one."""
    k = F.col("event_id") % 3
    said = F.when(k == 1, F.col("event_type")).when(k == 2, F.concat(F.lit("решение исследователя (было: "), "event_type", F.lit(")")))
    return table(spark, sf_dir, "events").select("event_id", judging.manual_reason(said).alias("reason"))


@query("""WITH d AS (SELECT doc_id % 7 AS search_id, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'relevant' ELSE 'uncertain' END AS status, length(text) AS start_char, text FROM documents)
SELECT search_id, id, 'F' || row_number() OVER (PARTITION BY search_id ORDER BY status <> 'relevant', start_char, id) AS marker, sha256(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END) AS text_hash FROM d""")
def q_selection_markers(spark, sf_dir):
    """Documents as findings of seven searches with their markers and what the model sees of them."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("search_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "relevant").otherwise("uncertain").alias("status"), F.length("text").alias("start_char"), "text")
    return judging.markers(d).select("search_id", "id", "marker", T.content_hash(F.col("model_text")).alias("text_hash"))


@query("SELECT doc_id AS id, sha256(CASE WHEN doc_id % 2 = 0 THEN substr(text, 6, 10) ELSE text END) AS quote_hash, CAST(CASE WHEN doc_id % 2 = 0 THEN 105 ELSE 100 END AS BIGINT) AS quote_start FROM documents")
def q_quotes(spark, sf_dir):
    """The selected ten characters of every second document, the whole text of the others."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(100).cast("long").alias("start_char"))
    r = F.array(F.struct(F.lit(105).cast("long").alias("start_char"), F.lit(115).cast("long").alias("end_char")))
    d = d.withColumn("selected_ranges", F.when(F.col("id") % 2 == 0, r).otherwise(F.slice(r, 1, 0)))
    return judging.quotes(d).select("id", T.content_hash(F.col("quote")).alias("quote_hash"), "quote_start")


@query(f"""WITH {_CAND}, n AS (SELECT search_id, count(*) AS t, count(CASE WHEN review_status = 'relevant' THEN 1 END) AS a, count(CASE WHEN review_status = 'rejected' THEN 1 END) AS r, count(CASE WHEN review_status = 'unreviewed' THEN 1 END) AS u FROM c GROUP BY 1)
SELECT search_id, 'Поиск: проверено ' || (a + r) || ' из ' || t || ' кандидатов, в выборке подходят ' || a || ', под вопросом 0, отклонено ' || r || CASE WHEN u > 0 THEN ', не проверено ' || u || ' (можно попросить «найди ещё»)' ELSE '' END || '.' AS line FROM n""")
def q_report_line(spark, sf_dir):
    """The line on every search's check."""
    count = lambda s: F.count(F.when(F.col("review_status") == s, 1)).alias(s)
    n = candidates(spark, sf_dir).groupBy("search_id").agg(F.count("*").alias("t"), *[count(s) for s in judging.STATES])
    return n.select("search_id", judging.report_line(F.lit("Поиск"), F.col("relevant") + F.col("rejected"), F.col("t"), {s: F.col(s) for s in judging.STATES}).alias("line"))


@query("""WITH m AS (SELECT conv_id, max(turn) AS top FROM conversations GROUP BY 1), asked AS (SELECT conv_id, top FROM m WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id + 1000000, NULL FROM m WHERE conv_id % 2 = 1)
SELECT conv_id AS conversation_id, CAST(coalesce(top, 0) + 1 AS BIGINT) AS position, 'user' AS role, top IS NULL AS is_new FROM asked UNION ALL SELECT conv_id, CAST(coalesce(top, 0) + 2 AS BIGINT), 'assistant', top IS NULL FROM asked WHERE conv_id % 3 = 0""")
def q_chat_turn(spark, sf_dir):
    """A turn in every second conversation and in as many new ones; every third question is answered."""
    c = table(spark, sf_dir, "conversations")
    messages = c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("position"), "role", "text")
    known = messages.select("conversation_id").distinct().withColumn("title", F.lit("old"))
    asked = known.select(F.when(F.col("conversation_id") % 2 == 0, F.col("conversation_id")).otherwise(F.col("conversation_id") + 1000000).alias("conversation_id"), F.lit("new question?").alias("text"))
    answers = asked.where("conversation_id % 3 = 0").select("conversation_id", F.lit("new answer").alias("text"))
    conversations, after = judging.turn(messages, known, asked, answers)
    made = conversations.where("title = 'new question?'").select("conversation_id", F.lit(True).alias("is_new"))
    lines = after.where("text in ('new question?', 'new answer')")
    return lines.join(made, "conversation_id", "left").select("conversation_id", "position", "role", F.coalesce("is_new", F.lit(False)).alias("is_new"))


@query("""WITH c AS (SELECT c_nationkey AS book_id, c_custkey, c_name, c_mktsegment, c_acctbal FROM customer), e AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CAST(c_acctbal AS BIGINT) DESC, c_name) AS r FROM c)
SELECT CAST(book_id AS BIGINT) AS book_id, count(*) AS sections, CASE WHEN book_id % 2 = 0 THEN string_agg(CASE WHEN r <= 30 THEN c_name END, ',' ORDER BY r) END AS entities, count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS building FROM e GROUP BY book_id""")
def q_agent_context(spark, sf_dir):
    """The agent's context of nations as books: customers as sections and entities, segments as states."""
    c = table(spark, sf_dir, "customer").withColumn("book_id", F.col("c_nationkey").cast("long"))
    outline = c.select("book_id", F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("chapter").alias("role"), F.lit(1).alias("level"), F.col("c_custkey").alias("start"))
    status = c.select("book_id").distinct().select("book_id", F.lit(True).alias("ready"), F.lit(False).alias("semantic"), (F.col("book_id") % 2 == 0).alias("entities"))
    entities = c.select("book_id", F.col("c_name").alias("canonical_name"), F.array("c_mktsegment").alias("aliases"), F.lit("person").alias("entity_type"), F.rint("c_acctbal").cast("long").alias("scene_count"))
    counts = c.groupBy("book_id", F.col("c_mktsegment").alias("review_status")).agg(F.count("*").alias("n"))
    found = judging.agent_context(outline, status, entities, counts)
    names = F.array_join(F.transform("entities", lambda x: x["canonical_name"]), ",")
    return found.select("book_id", F.size("outline").cast("long").alias("sections"), names.alias("entities"), F.coalesce(F.try_element_at("selection", F.lit("BUILDING")), F.lit(0)).alias("building"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Сцены: 2 из 5 · ' || event_type WHEN 1 THEN 'Сцены: ' || event_type WHEN 2 THEN 'Эмбеддинги…' ELSE 'other: 1 из 3' END AS line,
CASE event_type WHEN 'click' THEN 'нет соединения с провайдером модели' ELSE 'ошибка провайдера модели (X)' END AS fault, CASE event_id % 2 WHEN 0 THEN 'text (E: why)' ELSE 'text' END AS cause,
CASE event_id % 3 WHEN 0 THEN 'Сцены (глава «t», сцена 2 из 5): d' WHEN 1 THEN 'Сцены (сцена 2 из 5): d' ELSE 'Сцены: d' END AS failed, CASE WHEN event_id % 2 = 0 THEN 'body|foot' ELSE 'body|' END AS answer, CAST(CASE WHEN event_id % 2 = 0 THEN 5 ELSE 9 END AS INTEGER) AS tokens FROM events""")
def q_presentation(spark, sf_dir):
    """Lines on progress, faults, causes, failed stages, answers and usage."""
    k, two, three, none = F.col("event_id") % 4, F.col("event_id") % 2, F.col("event_id") % 3, F.lit(None).cast("string")
    line = presentation.progress(F.when(k < 2, "scenes").when(k == 2, "embeddings").otherwise("other"), F.when(k == 3, 1).otherwise(2), F.when(k == 0, 5).when(k == 3, 3).otherwise(1), F.when(k < 2, F.col("event_type")))
    body, foot = presentation.split_answer(F.when(two == 0, F.lit("body\n" + presentation.FOOTER + "\nfoot\n")).otherwise(F.lit("body")))
    failed = presentation.preparation_fault(F.lit("scenes"), F.when(three == 0, F.lit("t")), F.when(three < 2, F.lit("2/5")), F.lit("d"))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"), presentation.fault(F.when(F.col("event_type") == "click", "connection"), F.lit("X")).alias("fault"), presentation.cause(F.lit("text"), F.lit("E"), F.when(two == 0, "why").otherwise(none)).alias("cause"), failed.alias("failed"), F.concat(body, F.lit("|"), foot).alias("answer"), presentation.used_tokens(F.when(two == 0, 5), F.lit(9)).cast("int").alias("tokens"))


@query("""WITH s AS (SELECT user_id AS book_id, count(*) AS c, count(CASE WHEN event_id % 10 < 9 THEN 1 END) AS sc, count(CASE WHEN event_type = 'click' THEN 1 END) AS ch FROM events GROUP BY 1)
SELECT book_id, x.nth AS nth, x.key AS key, x.count AS count, x.state AS state FROM (SELECT book_id, unnest([
{'nth': 0, 'key': 'scenes', 'count': sc || '/' || c || ' глав', 'state': CASE WHEN sc = c THEN 'done' ELSE 'todo' END}, {'nth': 1, 'key': 'chunks', 'count': CAST(ch AS VARCHAR), 'state': CASE WHEN sc = c AND ch > 0 THEN 'done' ELSE 'todo' END},
{'nth': 2, 'key': 'embeddings', 'count': ch || '/' || ch, 'state': CASE WHEN ch > 0 THEN 'done' ELSE 'todo' END}, {'nth': 3, 'key': 'mentions', 'count': sc || '/' || c || ' сцен', 'state': CASE WHEN sc = c THEN 'done' ELSE 'todo' END},
{'nth': 4, 'key': 'chapter_entities', 'count': '0/' || c || ' глав', 'state': 'todo'}, {'nth': 5, 'key': 'book_entities', 'count': ch || ' · связей со сценами 7', 'state': CASE WHEN ch > 0 THEN 'done' ELSE 'todo' END},
{'nth': 6, 'key': 'narrative', 'count': '0/0 сцен', 'state': 'todo'}, {'nth': 7, 'key': 'narrative_links', 'count': 'сцен 0 · событий 0', 'state': 'todo'}]) AS x FROM s)""")
def q_checklist(spark, sf_dir):
    """What is done of the preparation of users' books."""
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("book_id")).agg(F.count("*").alias("chapters"), F.count(F.when(F.col("event_id") % 10 < 9, 1)).alias("scene_chapters"), F.count(F.when(F.col("event_type") == "click", 1)).alias("chunks"))
    zero = F.lit(0)
    s = s.withColumns({"scenes": F.col("chapters"), "embedded_chunks": F.col("chunks"), "extracted_scenes": F.col("scene_chapters"), "chapter_entity_chapters": zero, "book_entities": F.col("chunks"), "presence_edges": F.lit(7), "narrative_scenes": zero, "annotated_scenes": zero, "scene_links": zero, "narrative_links": zero})
    return presentation.checklist(s).select("book_id", "nth", "key", "count", "state")


@query("""SELECT o_custkey AS book_id, o_orderkey AS chapter_id, CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'todo' END AS scenes_state, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'done' ELSE 'todo' END AS chunks_state,
CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'todo' END AS mentions_state, 'done' AS chapter_entities_state, CASE WHEN o_orderkey % 7 = 0 THEN 'broken' ELSE '' END AS error FROM orders""")
def q_chapter_table(spark, sf_dir):
    """Orders as chapters with the state of each stage and failures of every seventh."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("chapter_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("stale").alias("scene_status"), F.lit(3).alias("scenes"), F.lit(2).alias("chunks"), F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(1).alias("embedded_chunks"), F.when(F.col("o_orderkey") % 3 == 0, 3).otherwise(0).alias("extracted_scenes"), F.lit("ready").alias("chapter_entity_status"))
    failures = o.where("chapter_id % 7 = 0").select("book_id", "chapter_id", F.lit("scenes").alias("key"), F.lit("broken").alias("message"))
    return presentation.chapter_table(o, failures)


@query("SELECT doc_id AS scene_id, sha256(CASE WHEN length(text) > 20 THEN substr(text, 1, 5) || '[C1]' || substr(text, 6, 10) || '[C2]' || substr(text, 16) ELSE text END) AS text_hash FROM documents")
def q_marked_text(spark, sf_dir):
    """Two chunk marks in every document of more than 20 characters."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scene_id"), F.lit(100).alias("start_char"), "text")
    chunks = d.where(F.length("text") > 20).select("scene_id", F.explode(F.array(F.lit(105), F.lit(115))).alias("start_char"), F.lit(0).alias("end_char"))
    return narrative.marked_text(d, chunks).select("scene_id", T.content_hash(F.col("text")).alias("text_hash"))


@query("""WITH s AS (SELECT o_custkey AS book_id, o_orderkey AS scene_id, o_orderkey * 100 AS base FROM orders),
e AS (SELECT s.*, l_linenumber AS n, l_orderkey * 10 + l_linenumber AS id, l_suppkey FROM lineitem JOIN s ON s.scene_id = l_orderkey), w AS (SELECT id, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS who FROM e GROUP BY 1)
SELECT book_id, id, base + n * 4 AS position, substr(repeat('abcdefghij', 5), CAST(greatest(0, n * 4 - 4) + 1 AS BIGINT), CAST(least(50, n * 4 + 2 + 4) - greatest(0, n * 4 - 4) AS BIGINT)) AS context,
CASE WHEN n * 4 + 2 <= 14 THEN 'first' WHEN n * 4 >= 14 THEN 'second' END AS chunk_level, who AS participants FROM e JOIN w USING (id)""")
def q_enriched_events(spark, sf_dir):
    """Line items as events of orders' scenes of fifty characters, with context, chunk and participant."""
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("scene_id"), (F.col("o_orderkey") * 100).alias("start_char"), F.lit("t").alias("title"), F.lit("abcdefghij" * 5).alias("text"))
    l = table(spark, sf_dir, "lineitem").join(s.select("book_id", F.col("scene_id").alias("l_orderkey")), "l_orderkey")
    n = F.col("l_linenumber")
    events = l.select("book_id", F.col("l_orderkey").alias("scene_id"), (F.col("l_orderkey") * 10 + n).alias("id"), (n * 4).alias("start_offset"), (n * 4 + 2).alias("end_offset"))
    part = lambda a, b, level: s.select("book_id", "scene_id", (F.col("start_char") + a).alias("start_char"), (F.col("start_char") + b).alias("end_char"), F.lit(level).alias("level"), F.lit("narrator").alias("representation"))
    people = l.select("book_id", (F.col("l_orderkey") * 10 + n).alias("event_id"), F.col("l_suppkey").alias("entity_id"))
    found = narrative.enriched(events, s, part(0, 14, "first").union(part(14, 50, "second")), people, 10)
    return found.select("book_id", "id", F.col("position").cast("long").alias("position"), "context", "chunk_level", F.array_join(F.col("participant_ids").cast("array<string>"), ",").alias("participants"))


@query("""WITH e AS (SELECT vec_id, label, vec_id % 20 AS scene_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT unnest(range(19)) AS a),
p AS (SELECT a, x.vec_id AS left_id, y.vec_id AS right_id, list_cosine_similarity(x.v, y.v) + CASE WHEN x.label = y.label THEN 0.05 ELSE 0 END AS s FROM l JOIN e x ON x.scene_id = a JOIN e y ON y.scene_id = a + 1)
SELECT CAST(a AS BIGINT) AS source_id, left_id, right_id, round(s, 6) AS score, 'параллель между сценами: r' || a AS hint FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, left_id, right_id) <= 3""")
def q_scene_link_anchors(spark, sf_dir):
    """Vectors as events of twenty scenes, each linked to the next: three best pairs a link."""
    e = table(spark, sf_dir, "embeddings").select(F.lit("b").alias("book_id"), F.col("vec_id").alias("id"), (F.col("vec_id") % 20).alias("scene_id"), F.col("embedding").alias("roles"), F.col("embedding").alias("story"), F.array("label").alias("people"))
    links = spark.range(19).select(F.lit("b").alias("book_id"), F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit("parallels").alias("type"), F.concat(F.lit("r"), "id").alias("reason"))
    return narrative.scene_link_anchors(e, links).select("source_id", "left_id", "right_id", F.round("score", 6).alias("score"), "hint")


@query("""SELECT event_id || '::' || (event_id + 1) AS pair_id, '{"pair_id":"' || event_id || '::' || (event_id + 1) || '","left":{"gist":"' || event_type || '","roles":"","context":"c","scene":"","modality":"actual","form":"narrator"},"right":{"gist":"g","roles":"","context":"c","scene":"","modality":"actual","form":"narrator"}' || CASE WHEN event_id % 2 = 0 THEN ',"hint":"h"' ELSE '' END || '}' AS payload FROM events""")
def q_pair_payload(spark, sf_dir):
    """Pairs of events as the oracle sees them, every second with a hint."""
    none = F.lit(None).cast("string")
    side = lambda i, g: F.struct(i.alias("id"), g.alias("gist"), none.alias("gist_roles"), F.lit("c").alias("context"), none.alias("scene_title"), none.alias("modality"), none.alias("chunk_representation"))
    e = table(spark, sf_dir, "events").select(side(F.col("event_id"), F.col("event_type")).alias("left"), side(F.col("event_id") + 1, F.lit("g")).alias("right"), F.when(F.col("event_id") % 2 == 0, "h").otherwise("").alias("hint"))
    return narrative.pair_payload(e)


@query("""WITH r AS (SELECT user_id AS book_id, event_id % 4 AS grp, CAST(event_id % 3 AS INTEGER) AS attempt, event_type = 'signup' AS failed, event_id AS seq, value FROM events),
f AS (SELECT book_id, grp, min(attempt) AS attempt FROM r WHERE NOT failed GROUP BY 1, 2), u AS (SELECT r.* FROM r JOIN f ON f.book_id = r.book_id AND f.grp = r.grp AND f.attempt = r.attempt WHERE NOT failed),
e AS (SELECT book_id, grp, seq % 5 AS a, 5 + seq % 2 AS b, min(seq) AS seq FROM u GROUP BY 1, 2, 3, 4), m AS (SELECT book_id, a, b, arg_min(seq, grp) AS seq, count(*) AS found FROM e GROUP BY 1, 2, 3)
SELECT book_id, CASE WHEN seq % 3 = 0 THEN b ELSE a END AS source_no, CASE WHEN seq % 3 = 0 THEN a ELSE b END AS target_no, found, seq % 3 < 2 AS directed, NULL AS failed_group FROM m
UNION ALL SELECT g.book_id, NULL, NULL, NULL, NULL, g.grp FROM (SELECT DISTINCT book_id, grp FROM r) g LEFT JOIN f ON f.book_id = g.book_id AND f.grp = g.grp WHERE f.attempt IS NULL""")
def q_scene_map(spark, sf_dir):
    """Events as replies of four groups a book in up to three attempts: links named by several groups are one; groups without an answer."""
    e = table(spark, sf_dir, "events")
    seq = F.col("event_id")
    direction = F.when(seq % 3 == 0, "b_to_a").when(seq % 3 == 1, "a_to_b")
    r = e.select(F.col("user_id").alias("book_id"), (seq % 4).alias("group"), (seq % 3).cast("int").alias("attempt"), (F.col("event_type") == "signup").alias("failed"), seq.alias("seq"), (seq % 5).alias("a"), (5 + seq % 2).alias("b"), F.lit("causes").alias("type"), F.lit(None).cast("string").alias("subtype"), direction.alias("direction"), F.lit("inferred").alias("basis"), F.lit("").alias("reason"))
    links, failures = narrative.scene_map(r.select("book_id", "group").distinct(), r)
    none = F.lit(None)
    return links.select("book_id", "source_no", "target_no", "found", "directed", none.cast("long").alias("failed_group")).unionByName(failures.select("book_id", none.cast("long").alias("source_no"), none.cast("long").alias("target_no"), none.cast("long").alias("found"), none.cast("boolean").alias("directed"), F.col("group").alias("failed_group")))


@query("""WITH s AS (SELECT o_custkey AS book_id, o_orderpriority AS chapter_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderpriority < '4'),
w AS (SELECT DISTINCT l_orderkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 2 = 0)
SELECT s.book_id, CAST(nth AS INTEGER) AS nth, id, 'T' || chapter_id AS chapter, coalesce((SELECT string_agg(s_name, ',' ORDER BY s_name) FROM w WHERE l_orderkey = s.id), '') AS characters FROM s""")
def q_scene_outline(spark, sf_dir):
    """Orders as scenes, suppliers of even number as persons: the outline of the ready chapters."""
    o = table(spark, sf_dir, "orders")
    scenes = o.select(F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("chapter_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("start_char"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.lit("h").alias("text_hash"))
    layers = scenes.select("book_id", "chapter_id").distinct().withColumn("status", F.when(F.col("chapter_id") < "4", "ready").otherwise("partial"))
    sections = layers.select("book_id", F.col("chapter_id").alias("id"), F.concat(F.lit("T"), "chapter_id").alias("title"))
    own = table(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("book_id")), "l_orderkey")
    presence = own.select("book_id", F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("scene_id")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"), F.when(F.col("s_suppkey") % 2 == 0, "person").otherwise("location").alias("entity_type"))
    people = presence.select("book_id", F.col("entity_id").alias("id")).distinct().join(s, "id")
    found = narrative.scene_outline(layers, scenes, sections, presence, people)
    return found.select("book_id", "nth", "id", "chapter", F.array_join("characters", ",").alias("characters"))


@query("SELECT user_id AS book_id, count(*) AS scenes, count(CASE WHEN event_id % 3 = 0 AND event_type <> 'view' THEN 1 END) AS annotated FROM events GROUP BY 1")
def q_narrative_progress(spark, sf_dir):
    """Events as scenes; a third is annotated, some of it by another method."""
    e = table(spark, sf_dir, "events")
    scenes = e.select(F.col("user_id").alias("book_id"), F.col("event_id").alias("scene_id"), F.lit("h").alias("text_hash"))
    done = e.where("event_id % 3 = 0").select(F.col("event_id").alias("scene_id"), F.lit("h").alias("text_hash"), F.lit("ready").alias("status"), F.when(F.col("event_type") == "view", "old").otherwise("m").alias("method_hash"))
    return narrative.progress(scenes, done, "m")
