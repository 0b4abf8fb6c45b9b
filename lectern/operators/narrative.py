"""Annotations, events and links between events and scenes, as checked tables.

Replies of a language model come as tables of parsed rows. Each check is one column of reasons; what fails is
kept with its reason, so nothing is dropped silently.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions import spans
from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import entities, vectors

# The words that replies may use.
REPRESENTATIONS = ("narrator", "direct_speech", "thought", "document", "mixed")
LEVELS = ("primary", "embedded")
EMBEDDED = ("letter", "dream", "story", "song")
EVENT_KINDS = ("change_of_state", "process", "state")
MODALITIES = ("actual", "hypothetical", "negated", "iterative", "dream", "reported")
LINKS = ("retells", "prefigures", "causes", "parallels")
DIRECTED = ("retells", "prefigures", "causes")
SUBTYPES = {"retells": "speech letter rumor memory summary", "prefigures": "dream prophecy omen promise hint", "causes": "physical motivational psychological enabling", "parallels": "situation roles motif contrast"}
BASES = ("explicit", "inferred", "suggestive")
MOST_EVENTS, CONTEXT_CHARS, GIST_CHARS, REASON_CHARS = 7, 300, 300, 200


def _text(c: str, most: int) -> Column:
    return F.col(c).isNotNull() & (F.trim(c) != "") & (F.length(c) <= most)


def _known(c: str, among: str = "entity_ids") -> Column:
    return F.col(c).isNull() | F.array_contains(among, F.col(c))


def fresh(scenes: DataFrame, done: DataFrame, method: str) -> DataFrame:
    """Scenes(scene_id, text_hash) without a ready annotation of their text by this method."""
    return scenes.join(done.where((F.col("status") == "ready") & (F.col("method_hash") == method)).select("scene_id", "text_hash"), ["scene_id", "text_hash"], "left_anti")


def chunk_annotations(replies: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations, problems) from replies(scene_id, chunk, context, representation, level, embedded_kind,
    speaker_entity_id) and scenes(scene_id, n_chunks, entity_ids). One fault refuses the scene's whole reply."""
    both = replies.join(scenes, "scene_id")
    fault = (
        F.when(~F.coalesce(F.col("chunk").between(1, F.col("n_chunks")), F.lit(False)), "chunk")
        .when(~_text("context", CONTEXT_CHARS), "context")
        .when(~F.coalesce(F.col("representation").isin(*REPRESENTATIONS), F.lit(False)), "representation")
        .when(~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)), "level")
        .when(F.col("embedded_kind").isNotNull() & ~F.col("embedded_kind").isin(*EMBEDDED), "embedded_kind")
        .when((F.col("level") == "primary") & F.col("embedded_kind").isNotNull(), "embedded_kind")
        .when(~_known("speaker_entity_id"), "speaker_entity_id")
    )
    judged = both.withColumn("problem", fault)
    counts = scenes.join(judged.groupBy("scene_id").agg(F.count("*").alias("n"), F.countDistinct("chunk").alias("d"), F.max("problem").alias("problem")), "scene_id", "left")
    whole = counts.select("scene_id", F.coalesce(F.col("problem"), F.when(F.col("n").isNull() | (F.col("d") < F.col("n_chunks")), "missing chunk").when(F.col("n") > F.col("d"), "repeated chunk")).alias("problem"))
    good = judged.drop("problem").join(whole.where("problem is null").select("scene_id"), "scene_id", "left_semi").withColumn("context", F.trim("context"))
    return good.drop("n_chunks", "entity_ids"), whole.where("problem is not null")


def event_rows(replies: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, skipped) from replies(scene_id, seq, surface_text, occurrence, gist, gist_roles, kind, modality,
    participants array<struct<entity_id,role>>, from_location, to_location) and scenes(scene_id, text, entity_ids
    [, text_hash, book_id]). Ids count the events that stay, from 0, in the order of replies.

    A bad event is skipped with a reason; a scene with more than seven events is refused whole."""
    def locate(text: pd.Series, form: pd.Series, nth: pd.Series) -> pd.DataFrame:
        found = [spans.resolve(t, f, None, None, None if pd.isna(n) else int(n)) or (None, None) for t, f, n in zip(text, form, nth, strict=True)]
        return pd.DataFrame({"start_char": pd.array([a for a, _ in found], "Int32"), "end_char": pd.array([b for _, b in found], "Int32")})

    many = F.count("*").over(Window.partitionBy("scene_id")) > MOST_EVENTS
    both = replies.withColumn("many", many).join(scenes, "scene_id")
    placed = both.withColumn("span", F.pandas_udf(locate, spans.SPAN)("text", "surface_text", "occurrence"))
    people = F.size("participants") > 0
    people = people & F.forall("participants", lambda p: F.array_contains(F.col("entity_ids"), p["entity_id"]) & (F.trim(p["role"]) != ""))
    fault = (
        F.when(F.col("many"), "too many events")
        .when(F.col("span.start_char").isNull(), "surface_text")
        .when(~_text("gist", GIST_CHARS), "gist")
        .when(~_text("gist_roles", GIST_CHARS), "gist_roles")
        .when(~F.coalesce(F.col("kind").isin(*EVENT_KINDS), F.lit(False)), "kind")
        .when(~F.coalesce(F.col("modality").isin(*MODALITIES), F.lit(False)), "modality")
        .when(~F.coalesce(people, F.lit(False)), "participants")
        .when(~_known("from_location") | ~_known("to_location"), "location")
    )
    judged = placed.withColumn("problem", fault)
    book, digest = (F.col(c) if c in scenes.columns else F.lit("") for c in ("book_id", "text_hash"))
    stays = judged.where("problem is null").withColumn("index", F.row_number().over(Window.partitionBy("scene_id").orderBy("seq")) - 1)
    key = F.concat_ws(":", book, "scene_id", digest, "index")
    good = stays.select("scene_id", F.concat(F.lit("event:"), T.uuid5_hex(key)).alias("event_id"), F.col("span.start_char").alias("start_offset"), F.col("span.end_char").alias("end_offset"), "surface_text", F.trim("gist").alias("gist"), F.trim("gist_roles").alias("gist_roles"), "kind", "modality", "participants", "from_location", "to_location")
    return good, judged.where("problem is not null").select("scene_id", "seq", "problem")


def retelling_side(representation: Column, level: Column, modality: Column) -> Column:
    """Whether an event is told inside the story: in speech, thought, a document, an embedded story or as reported."""
    return F.coalesce(representation.isin("direct_speech", "thought", "document") | (level == "embedded") | (modality == "reported"), F.lit(False))


def shortlist(events: DataFrame, known: DataFrame, k: int = 5, floor: float = 0.72, factor: float = 3.0, bonus: float = 0.05) -> DataFrame:
    """(book_id, left_id, right_id, score, required): candidate pairs of events of different scenes, in reading order.

    Nearest by roles, nearest by gist (with a bonus for a shared participant), the best partners of retold
    events, and known pairs; at most max(required, factor x events) for each book, the best first.

    events(book_id, id, scene_id, position, roles, story, people array, retold)."""
    a = events.select("book_id", *[F.col(c).alias(f"a_{c}") for c in ("id", "scene_id", "position", "roles", "story", "people", "retold")])
    b = events.select("book_id", *[F.col(c).alias(f"b_{c}") for c in ("id", "scene_id", "position", "roles", "story", "people", "retold")])
    # every event against those of other scenes of its book, both ways, as each side has its own best
    pairs = a.join(b, "book_id").where("a_scene_id <> b_scene_id")
    shared = F.coalesce(F.arrays_overlap("a_people", "b_people"), F.lit(False))
    pairs = pairs.select("book_id", "a_id", "b_id", "a_position", "b_position", "a_retold", shared.alias("shared"), V.cosine(F.col("a_roles"), F.col("b_roles")).alias("by_roles"), V.cosine(F.col("a_story"), F.col("b_story")).alias("story"))
    pairs = pairs.withColumn("by_story", F.col("story") + F.when(F.col("shared"), bonus).otherwise(0.0))
    w = lambda *order: Window.partitionBy("book_id", "a_id").orderBy(*order, "b_id")
    marked = pairs.withColumns({
        "r1": F.row_number().over(w(F.desc_nulls_last("by_roles"))), "r2": F.row_number().over(w(F.desc_nulls_last("by_story"))),
        "r3": F.row_number().over(w(F.desc(F.col("shared").cast("int")), F.desc(F.coalesce("story", F.lit(0.0))))),
    })
    near1, near2 = (F.col("r1") <= k) & (F.col("by_roles") >= floor), (F.col("r2") <= k) & (F.col("by_story") >= floor)
    told = F.col("a_retold") & F.col("shared") & (F.col("r3") <= k)
    score = F.greatest(F.when(near1, F.col("by_roles")), F.when(near2, F.col("by_story")), F.lit(floor))
    found = marked.where(near1 | near2 | told).select("book_id", "a_id", "b_id", "a_position", "b_position", score.alias("score"), F.coalesce(told, F.lit(False)).alias("required"))
    p = events.select("book_id", "id", "position")
    k1 = known.join(p.select("book_id", F.col("id").alias("a_id"), F.col("position").alias("a_position")), ["book_id", "a_id"]).join(p.select("book_id", F.col("id").alias("b_id"), F.col("position").alias("b_position")), ["book_id", "b_id"]).where("a_id <> b_id")
    every = found.unionByName(k1.select("book_id", "a_id", "b_id", "a_position", "b_position", F.lit(floor).alias("score"), F.lit(True).alias("required")))
    first = F.struct(F.col("a_position").alias("p"), F.col("a_id").alias("i"))
    second = F.struct(F.col("b_position").alias("p"), F.col("b_id").alias("i"))
    one = every.groupBy("book_id", F.least(first, second).alias("l"), F.greatest(first, second).alias("r")).agg(F.max("score").alias("score"), F.max("required").alias("required"))
    sizes = events.groupBy("book_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("book_id").orderBy(F.desc("required"), F.desc("score"), "l.i", "r.i")
    need = F.sum(F.col("required").cast("int")).over(Window.partitionBy("book_id"))
    ranked = one.join(sizes, "book_id").withColumns({"k": F.row_number().over(order), "need": need})
    return ranked.where(F.col("k") <= F.greatest("need", F.round(F.lit(factor) * F.col("n")))).select("book_id", F.col("l.i").alias("left_id"), F.col("r.i").alias("right_id"), "score", "required")


def _subtype() -> Column:
    allowed = F.create_map(*[F.lit(x) for p in SUBTYPES.items() for x in p])
    return F.when(F.array_contains(F.split(F.try_element_at(allowed, F.col("type")), " "), F.col("subtype")), F.col("subtype"))


def _reason() -> Column:
    return T.shorten(F.coalesce(T.clean(F.col("reason")), F.lit("")), REASON_CHARS)


def link_decisions(pairs: DataFrame, replies: DataFrame) -> DataFrame:
    """pairs(pair_id, left_id, right_id) with the first reply of a known type; without one the type is none.

    Other fields are lenient: unknown values become null, confidence is cut to 0..1, a long reason is shortened."""
    good = entities.first_valid(replies, ["pair_id"], F.col("type").isin(*LINKS, "none"))
    some = F.col("type") != "none"
    conf = F.when(F.isnan("confidence"), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    clean = good.select("pair_id", "type", _subtype().alias("subtype"), F.when(F.col("type").isin(*DIRECTED) & F.col("direction").isin("left_to_right", "right_to_left"), F.col("direction")).alias("direction"), F.when(some & F.col("basis").isin(*BASES), F.col("basis")).alias("basis"), conf.alias("confidence"), _reason().alias("reason"))
    both = pairs.join(clean, "pair_id", "left")
    return both.withColumns({"confidence": F.when(F.col("type").isNull(), 0.0).otherwise(F.col("confidence")), "reason": F.coalesce("reason", F.lit("")), "type": F.coalesce("type", F.lit("none"))})


def link_rows(decided: DataFrame) -> DataFrame:
    """Links to store: none is left out, and the direction decides source and target."""
    back = F.coalesce(F.col("direction") == "right_to_left", F.lit(False))
    return decided.where("type <> 'none'").select(F.when(back, F.col("right_id")).otherwise(F.col("left_id")).alias("source_id"), F.when(back, F.col("left_id")).otherwise(F.col("right_id")).alias("target_id"), "type", "subtype", "basis", F.col("direction").isNotNull().alias("directed"), "confidence", "reason")


def scene_links(replies: DataFrame, scenes: DataFrame, focus: DataFrame) -> DataFrame:
    """Links (book_id, a, b, type, subtype, direction, basis, reason, found) of scene numbers, the earlier first.

    replies(book_id, group, seq, a, b, type, subtype, direction, basis, reason): a link counts if its numbers are
    known, one is in the group's focus(book_id, group, n) and its type is known; the first of a pair stays, and
    ``found`` is in how many groups the pair was named."""
    n = scenes.select("book_id", "n")
    ok = replies.where("a <> b").where(F.col("type").isin(*LINKS))
    ok = ok.join(n.withColumnRenamed("n", "a"), ["book_id", "a"], "left_semi").join(n.withColumnRenamed("n", "b"), ["book_id", "b"], "left_semi")
    f = focus.select("book_id", "group", F.col("n").alias("x"))
    ok = ok.withColumn("x", F.explode(F.array("a", "b"))).join(f, ["book_id", "group", "x"], "left_semi").drop("x").dropDuplicates(["book_id", "group", "seq"])
    way = F.when(F.col("type").isin(*DIRECTED) & F.col("direction").isin("a_to_b", "b_to_a"), F.col("direction"))
    turned = F.when(F.col("a") > F.col("b"), F.when(way == "a_to_b", "b_to_a").when(way == "b_to_a", "a_to_b")).otherwise(way)
    rows = ok.select("book_id", "group", "seq", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "type", _subtype().alias("subtype"), turned.alias("direction"), F.when(F.col("basis").isin(*BASES), F.col("basis")).alias("basis"), _reason().alias("reason"))
    w = Window.partitionBy("book_id", "a", "b").orderBy("group", "seq")
    groups = F.size(F.collect_set("group").over(Window.partitionBy("book_id", "a", "b")))
    return rows.withColumns({"found": groups, "k": F.row_number().over(w)}).where("k = 1").drop("k", "group", "seq")


def focus_groups(scenes: DataFrame, size: int = 6) -> DataFrame:
    """scenes(book_id, n from 1) with ``group``: consecutive sixes."""
    return scenes.withColumn("group", F.floor((F.col("n") - 1) / size))


def outline(scenes: DataFrame, most: int) -> DataFrame:
    """(book_id, lines, gist_chars): one line for each scene(book_id, n, chapter, title, summary), with the longest
    gist of 160, 80 or no characters that fits; lines are null where nothing fits."""
    gist = T.first_sentence(F.col("summary"))
    made = scenes.select("book_id", "n", *[F.concat_ws(" — ", F.concat_ws(" | ", F.col("n").cast("string"), "chapter", "title"), *([T.shorten(gist, c)] if c else [])).alias(f"l{c}") for c in (160, 80, 0)])
    all_ = made.groupBy("book_id").agg(*[F.array_sort(F.collect_list(F.struct("n", f"l{c}")))[f"l{c}"].alias(f"l{c}") for c in (160, 80, 0)])
    size = lambda c: F.aggregate(f"l{c}", F.lit(0), lambda a, x: a + F.length(x) + 1)
    pick = F.when(size(160) <= most, 160).when(size(80) <= most, 80).when(size(0) <= most, 0)
    sized = all_.withColumn("gist_chars", pick)
    return sized.select("book_id", F.when(F.col("gist_chars") == 160, F.col("l160")).when(F.col("gist_chars") == 80, F.col("l80")).when(F.col("gist_chars") == 0, F.col("l0")).alias("lines"), "gist_chars")


# What a link between scenes is called in a hint.
SCENE_LINKS = {"retells": "пересказ", "prefigures": "предвестие", "causes": "причина", "parallels": "параллель"}


def marked_text(scenes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(scene_id, text): a scene's text with [C1], [C2] ... before its chunks(scene_id, start_char, end_char), in reading order."""
    inside = chunks.join(scenes.select("scene_id", F.col("start_char").alias("base")), "scene_id").select("scene_id", (F.col("start_char") - F.col("base")).cast("int").alias("a"))
    cuts = inside.groupBy("scene_id").agg(F.array_sort(F.collect_list("a")).alias("cuts"))
    both = scenes.join(cuts, "scene_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    until = F.concat(F.slice("cuts", 2, F.greatest(F.size("cuts") - 1, F.lit(0))), F.array(F.length("text")))
    parts = F.transform("cuts", lambda a, i: F.concat(F.lit("[C"), i + 1, F.lit("]"), F.substring("text", a + 1, F.get(until, i) - a)))
    return both.select("scene_id", F.concat(F.substring("text", F.lit(1), F.coalesce(F.get("cuts", F.lit(0)), F.length("text"))), F.array_join(parts, "")).alias("text"))


def enriched(events: DataFrame, scenes: DataFrame, chunks: DataFrame, participants: DataFrame, context: int = CONTEXT_CHARS) -> DataFrame:
    """events(book_id, scene_id, id, start_offset, end_offset, ...) with position, scene_title, context, participant_ids, chunk_level, chunk_representation.

    Events of scenes(book_id, scene_id, start_char, title, text) that aren't there go. The chunk(book_id, scene_id, start_char, end_char,
    level, representation) is the first that contains the event; participants(book_id, event_id, entity_id)."""
    s = scenes.select("book_id", "scene_id", F.col("start_char").alias("base"), F.col("title").alias("scene_title"), F.col("text").alias("whole"))
    own = events.join(s, ["book_id", "scene_id"])
    side = F.greatest(F.lit(0), F.floor((F.lit(context) - (F.col("end_offset") - F.col("start_offset"))) / 2))
    left, right = F.greatest(F.lit(0), F.col("start_offset") - side), F.least(F.length("whole"), F.col("end_offset") + side)
    own = own.withColumns({"position": F.col("base") + F.col("start_offset"), "scene_title": F.coalesce("scene_title", F.lit("")), "context": F.substring("whole", (left + 1).cast("int"), (right - left).cast("int"))})
    k = chunks.select(F.col("book_id").alias("kb"), F.col("scene_id").alias("ks"), F.col("start_char").alias("a"), F.col("end_char").alias("b"), "level", "representation")
    hit = own.select("book_id", "scene_id", "id", "base", "start_offset", "end_offset").join(k, (F.col("book_id") == F.col("kb")) & (F.col("scene_id") == F.col("ks")) & (F.col("a") - F.col("base") <= F.col("start_offset")) & (F.col("end_offset") <= F.col("b") - F.col("base")))
    first = hit.groupBy("book_id", "id").agg(F.min_by("level", "a").alias("chunk_level"), F.min_by("representation", "a").alias("chunk_representation"))
    people = participants.groupBy("book_id", F.col("event_id").alias("id")).agg(F.array_sort(F.collect_set("entity_id")).alias("participant_ids"))
    out = own.drop("whole", "base").join(first, ["book_id", "id"], "left").join(people, ["book_id", "id"], "left")
    return out.withColumn("participant_ids", F.coalesce("participant_ids", F.array().cast(dict(people.dtypes)["participant_ids"])))


def scene_link_anchors(events: DataFrame, links: DataFrame, per_link: int = 3, bonus: float = 0.05, block: int = 4000) -> DataFrame:
    """(book_id, source_id, target_id, left_id, right_id, score, hint): the most similar pairs of events of each two linked scenes.

    events(book_id, id, scene_id, roles, story, people), links(book_id, source_id, target_id, type, reason). A shared participant counts a
    little; scores equal to 9 digits are ties, to the smaller ids. Scenes meet as matrix products, those of more than ``block`` events in blocks,
    of which only the best pairs leave a task."""
    label = F.try_element_at(F.create_map(*[F.lit(x) for pair in SCENE_LINKS.items() for x in pair]), F.col("type"))
    hint = F.trim(F.concat(label, F.lit(" между сценами: "), F.coalesce("reason", F.lit(""))))
    size = events.groupBy("book_id", "scene_id").agg(F.ceil(F.count("*") / block).alias("n"))
    ends = links.select("book_id", "source_id", "target_id").distinct()
    for end, n in (("source_id", "n_left"), ("target_id", "n_right")):
        ends = ends.join(size.select("book_id", F.col("scene_id").alias(end), F.col("n").alias(n)), ["book_id", end])
    on = ["book_id", "source_id", "target_id", "lb", "rb"]

    def side(end: str, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        e = events.select("book_id", F.col("scene_id").alias(end), "id", "roles", "story", "people")
        return ends.join(e, ["book_id", end]).withColumns({mine: F.pmod(F.xxhash64("id"), F.col(own)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1))}).drop("n_left", "n_right")

    left, right = side("source_id", "n_left", "lb", "rb", "n_right"), side("target_id", "n_right", "rb", "lb", "n_left")
    kinds = dict(left.dtypes)
    none = to_arrow_schema(left.select(*on[:3], F.col("id").alias("left_id"), F.col("id").alias("right_id"), F.lit(0.0).alias("score")).schema)

    def best(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return none.empty_table()
        a, b = a.sort_by("id"), b.sort_by("id")
        near = [(vectors.unit_rows(a.column(c)), vectors.unit_rows(b.column(c))) for c in ("story", "roles")]
        p, q = _holders(a.column("people")), _holders(b.column("people"))
        shared = [(p[x], q[x]) for x in p.keys() & q.keys()]

        def score(i: slice, j: slice) -> np.ndarray:
            s = np.maximum(*(vectors.cosines((x[0][i], x[1][i]), (y[0][j], y[1][j]), 0.0) for x, y in near))
            met = np.zeros(s.shape, bool)
            for m, n in shared:
                met[np.ix_(m[np.searchsorted(m, i.start) : np.searchsorted(m, i.stop)] - i.start, n[np.searchsorted(n, j.start) : np.searchsorted(n, j.stop)] - j.start)] = True
            return s + bonus * met

        r, c, s = vectors.best_columns(score, a.num_rows, b.num_rows, per_link)
        first = np.lexsort((c, r, -np.round(np.where(np.isnan(s), np.inf, s), 9)))[:per_link]
        r, c, s = r[first], c[first], s[first]
        ends = [pa.array([x.as_py()] * len(r), x.type) for x in key[:3]]
        return pa.table([*ends, a.column("id").take(r), b.column("id").take(c), pa.array(s)], names=[*on[:3], "left_id", "right_id", "score"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in on[:3]) + f", left_id {kinds['id']}, right_id {kinds['id']}, score double"
    right = right.withColumnsRenamed({c: f"{c}_r" for c in on})  # sides of one table have the same columns
    found = left.groupBy(*on).cogroup(right.groupBy(*[f"{c}_r" for c in on])).applyInArrow(best, schema)
    ranked = found.join(links.select("book_id", "source_id", "target_id", hint.alias("hint")), ["book_id", "source_id", "target_id"])
    w = Window.partitionBy("book_id", "source_id", "target_id").orderBy(F.desc(F.round("score", 9)), "left_id", "right_id")
    return ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_link).drop("r")


def _holders(people: pa.ChunkedArray) -> dict:
    """Each participant's rows, ascending."""
    out: dict = {}
    for i, each in enumerate(people.to_pylist()):
        for x in {x for x in each or () if x is not None}:
            out.setdefault(x, []).append(i)
    return {x: np.array(rows) for x, rows in out.items()}


def pair_payload(pairs: DataFrame) -> DataFrame:
    """(pair_id, payload): pairs(left, right, hint) of enriched events as JSON for the oracle; the id joins theirs by ``::``."""
    side = lambda c: F.struct(F.col(f"{c}.gist").alias("gist"), F.coalesce(F.col(f"{c}.gist_roles"), F.lit("")).alias("roles"), F.col(f"{c}.context").alias("context"), F.coalesce(F.col(f"{c}.scene_title"), F.lit("")).alias("scene"), F.coalesce(F.col(f"{c}.modality"), F.lit("actual")).alias("modality"), F.coalesce(F.col(f"{c}.chunk_representation"), F.lit("narrator")).alias("form"))
    pair = F.concat_ws("::", "left.id", "right.id")
    return pairs.select(pair.alias("pair_id"), F.to_json(F.struct(pair.alias("pair_id"), side("left").alias("left"), side("right").alias("right"), F.nullif("hint", F.lit("")).alias("hint"))).alias("payload"))


def scene_map(groups: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, failures) of the groups(book_id, group) that an oracle was asked about: replies(book_id, group, attempt, failed, seq, a, b, type, subtype, direction, basis, reason).

    A pair (a, b) of scene numbers that several groups name is one link, the first reply's, with ``found`` = how often. The first
    attempt of a group without a fault counts; a group without one is a failure. A row with null a only says that a group was answered."""
    good = replies.where(~F.col("failed"))
    first = good.groupBy("book_id", "group").agg(F.min("attempt").alias("attempt"))
    used = good.join(first, ["book_id", "group", "attempt"]).where("a is not null")
    names = ("type", "subtype", "direction", "basis", "reason")
    each = used.groupBy("book_id", "group", "a", "b").agg(F.min(F.struct("seq", *names)).alias("x"))
    merged = each.groupBy("book_id", "a", "b").agg(F.min_by("x", "group").alias("x"), F.count("*").alias("found"))
    back = F.col("x.direction") == "b_to_a"
    links = merged.select("book_id", F.when(back, F.col("b")).otherwise(F.col("a")).alias("source_no"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("target_no"), "x.type", "x.subtype", F.col("x.direction").isNotNull().alias("directed"), "x.basis", "x.reason", "found")
    return links, groups.join(first.select("book_id", "group"), ["book_id", "group"], "left_anti")


def scene_outline(layers: DataFrame, scenes: DataFrame, sections: DataFrame, presence: DataFrame, people: DataFrame) -> DataFrame:
    """(book_id, nth, id, title, summary, text_hash, chapter, characters): scenes of ready layers in reading order with who is present.

    presence(book_id, entity_id, scene_id), people(book_id, id, canonical_name, entity_type): persons only, by name."""
    ready = scenes.join(layers.where("status = 'ready'").select("book_id", "chapter_id"), ["book_id", "chapter_id"], "left_semi")
    who = presence.join(people.where("entity_type = 'person'").select("book_id", F.col("id").alias("entity_id"), "canonical_name"), ["book_id", "entity_id"])
    names = who.groupBy("book_id", F.col("scene_id").alias("id")).agg(F.array_sort(F.collect_list("canonical_name")).alias("characters"))
    titles = sections.select("book_id", F.col("id").alias("chapter_id"), F.col("title").alias("chapter"))
    both = ready.join(titles, ["book_id", "chapter_id"], "left").join(names, ["book_id", "id"], "left")
    order = Window.partitionBy("book_id").orderBy("start_char", "id")
    return both.select("book_id", F.row_number().over(order).alias("nth"), "id", "title", "summary", "text_hash", "chapter", F.coalesce("characters", F.array().cast("array<string>")).alias("characters"))


def progress(scenes: DataFrame, done: DataFrame, method: str) -> DataFrame:
    """(book_id, scenes, annotated): how many scenes of each book have a ready annotation of their text by this method."""
    ok = done.where((F.col("status") == "ready") & (F.col("method_hash") == method)).select("scene_id", "text_hash", F.lit(1).alias("ok")).distinct()
    return scenes.join(ok, ["scene_id", "text_hash"], "left").groupBy("book_id").agg(F.count("*").alias("scenes"), F.count("ok").alias("annotated"))


def rebuilt(events: DataFrame, scene_map_links: DataFrame, replies: DataFrame, known: DataFrame | None = None, per_link: int = 3, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, decisions, links): event links from scene links, the shortlist and an oracle's replies, for all books at once.

    events are as ``shortlist`` and ``scene_link_anchors`` take them; the best pairs of linked scenes and ``known``(book_id, a_id, b_id)
    are required candidates. A pair's id is ``left::right``; links carry their book."""
    near = scene_link_anchors(events, scene_map_links, per_link).select("book_id", F.col("left_id").alias("a_id"), F.col("right_id").alias("b_id"))
    must = near if known is None else near.unionByName(known.select("book_id", "a_id", "b_id"))
    pairs = shortlist(events, must.distinct(), k).withColumn("pair_id", F.concat_ws("::", "left_id", "right_id"))
    decided = link_decisions(pairs, replies)
    side = events.select("book_id", F.col("id").alias("source_id"))
    return pairs, decided, link_rows(decided).join(side, "source_id")
