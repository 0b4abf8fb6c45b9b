"""Edits of a book's structure by people, its review and its reading, over many sections at once.

Positions count elements, chars count code points of the canonical text. Functions that edit return the new tables and a
table of faults; an edit with a fault changes nothing. Store results as new versions, so that an edit can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import intervals

# Operations on the opening of a section, roles of blocks, what a message says about a place.
OPERATIONS = ("epigraph", "attribution", "opening", "body", "footnotes", "clear_epigraph")
BLOCK_ROLES = ("body", "epigraph", "footnotes")
_START_OF, _POSITION = r"Начало раздела\s+(\d+)", r"(?i)(?:['\"]?position['\"]?\s*[:=]|\bpositions?\s+)\s*(\d+)"
#: Versions of a structure that can be undone, and the longest heading of a part.
HISTORY, HEADING = 20, 180


def block_id(book: Column, role: Column, section: Column, start: Column, end: Column) -> Column:
    """``book:b:`` and a hash of what the block is and where."""
    return F.concat(book, F.lit(":b:"), T.uuid5_hex(F.concat_ws(":", book, role, section, start, end)))


def merge_spans(manual: DataFrame, automatic: DataFrame, by: list[str]) -> DataFrame:
    """(by, start_char, end_char, manual): manual ranges, and the parts of automatic ones that no manual range covers."""
    base = automatic.select(*by, "start_char", "end_char").withColumn("__k", F.monotonically_increasing_id())
    k = [*by, "__k"]
    near = base.select(*k, F.col("start_char").alias("__a"), F.col("end_char").alias("__b")).join(manual.select(*by, "start_char", "end_char"), by).where("start_char < __b and end_char > __a")
    rest = intervals.subtract(base, near.select(*k, "start_char", "end_char"), k)
    return manual.select(*by, "start_char", "end_char", F.lit(True).alias("manual")).unionByName(rest.select(*by, "start_char", "end_char", F.lit(False).alias("manual")))


def split_merges(merges: DataFrame, blocks: DataFrame, manual: DataFrame) -> DataFrame:
    """(book_id, start, end): automatic merges of elements, cut where blocks begin, end or name their source, longer than one
    element and clear of manual merges."""
    cuts = blocks.select("book_id", F.explode(F.array("start", "end", "attribution_start")).alias("cut")).where("cut is not null").distinct()
    inner = merges.select("book_id", F.col("start").alias("a"), F.col("end").alias("b")).join(cuts, "book_id").where("a < cut and cut < b")
    edges = inner.select("book_id", "a", "cut").unionByName(merges.select("book_id", F.col("start").alias("a"), F.explode(F.array("start", "end")).alias("cut"))).distinct()
    parts = edges.withColumn("end", F.lead("cut").over(Window.partitionBy("book_id", "a").orderBy("cut"))).where("end - cut > 1").select("book_id", F.col("cut").alias("start"), "end")
    m = manual.select(F.col("book_id").alias("mb"), F.col("start").alias("ms"), F.col("end").alias("me"))
    return parts.join(m, (F.col("book_id") == F.col("mb")) & (F.col("start") < F.col("me")) & (F.col("ms") < F.col("end")), "left_anti")


def block_faults(blocks: DataFrame, sections: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, id, problem) of blocks(book_id, id, section_id, role, start, end, attribution_start) that break a rule.

    sections(book_id, id, start, end), books(book_id, n_elements). Ids are unique, roles known, ranges within the book and the
    section, sources within their block, and blocks of a section apart from each other."""
    s = sections.select("book_id", F.col("id").alias("section_id"), F.col("start").alias("ss"), F.col("end").alias("se"), F.lit(True).alias("known"))
    same, side = Window.partitionBy("book_id", "id"), Window.partitionBy("book_id", "section_id").orderBy("start", "end", "id")
    rows = blocks.join(books.select("book_id", "n_elements"), "book_id").join(s, ["book_id", "section_id"], "left")
    rows = rows.withColumns({"copies": F.count("*").over(same), "before": F.max("end").over(side.rowsBetween(Window.unboundedPreceding, -1))})
    problem = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id").when(F.col("copies") > 1, "repeated id").when(~F.coalesce(F.col("role").isin(*BLOCK_ROLES), F.lit(False)), "role")
        .when(~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n_elements")), F.lit(False)), "bounds")
        .when(F.col("section_id").isNotNull() & (F.col("known").isNull() | (F.col("ss") > F.col("start")) | F.coalesce(F.col("end") > F.col("se"), F.lit(False))), "section")
        .when(F.col("attribution_start").isNotNull() & ~F.col("attribution_start").between(F.col("start"), F.col("end") - 1), "attribution")
        .when(F.col("section_id").isNotNull() & (F.col("before") > F.col("start")), "overlap")
    )
    return rows.select("book_id", "id", problem.alias("problem")).where("problem is not null")


def proposals(rows: DataFrame, roles: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of section proposals(start, end, level, role, title_position, visible_from, visible_to, batch_from, batch_to).

    A proposal begins in its batch and stays, with its title, in what was visible."""
    fault = (
        F.when(F.col("start").isNull() | ~F.col("start").between(F.col("visible_from"), F.col("visible_to") - 1), "start")
        .when(F.col("end").isNotNull() & ~((F.col("end") > F.col("start")) & (F.col("end") <= F.col("visible_to"))), "end")
        .when(~F.coalesce(F.col("level").between(0, 9), F.lit(False)), "level").when(~F.coalesce(F.col("role").isin(*roles), F.lit(False)), "role")
        .when(F.col("title_position").isNotNull() & ~F.col("title_position").between(F.col("visible_from"), F.col("visible_to") - 1), "title")
        .when(~F.col("start").between(F.col("batch_from"), F.col("batch_to") - 1), "context")
    )
    judged = rows.withColumn("reason", fault)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def edit_openings(sections: DataFrame, blocks: DataFrame, elements: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, blocks, faults) after edits(book_id, section_id, operation, start, end), at most one for each section.

    sections(book_id, id, start, end, title_position, body_start), blocks(book_id, id, section_id, role, start, end, attribution_start),
    elements(book_id, pos, type). A range marks an epigraph, its source, the opening, the body's begin or notes; blocks it
    meets give way, and the body begins after what is left of the epigraphs."""
    key = ["book_id", "section_id"]
    # sections, blocks and edits of a section meet in one shuffle and one order, so that a task sorts once, whatever the rules ask for
    loose = F.col("book_id").isNull() | F.col("section_id").isNull()
    rows = edits.select(*key, F.struct("operation", F.col("start").alias("es"), F.col("end").alias("ee")).alias("e"))
    rows = rows.unionByName(sections.where("book_id is not null and id is not null").select("book_id", F.col("id").alias("section_id"), F.struct(*sections.columns).alias("s")), allowMissingColumns=True)
    rows = rows.unionByName(blocks.where(~loose).select(*key, F.struct(*blocks.columns).alias("b")), allowMissingColumns=True)
    rows = rows.withColumns({"bs": F.col("b.start"), "be": F.col("b.end"), "bid": F.col("b.id"), "role": F.col("b.role")})
    epigraph, notes = F.coalesce(F.col("role") == "epigraph", F.lit(False)), F.coalesce(F.col("role") == "footnotes", F.lit(False))
    hole = F.when(epigraph & F.col("bs").isNotNull(), F.col("be"))
    all_of, ordered = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("bs", "bid")
    rows = rows.withColumns({"nth": F.row_number().over(ordered), "cover": F.max(hole).over(ordered.rowsBetween(Window.unboundedPreceding, -1))})
    place = F.when(F.col("s").isNotNull(), F.struct(F.col("s.start").alias("ss"), F.col("s.end").alias("se"), F.col("s.title_position").alias("title_position"), F.col("s.body_start").alias("body_start")))
    rows = rows.withColumns({"own": F.col("e").isNotNull(), "e": F.coalesce("e", F.max("e").over(all_of)), "place": F.max(place).over(all_of)})
    rows = rows.select(*key, "s", "b", "bs", "be", "bid", "role", "nth", "cover", "own", "e.*", "place.*", F.col("e").isNotNull().alias("edited"))
    meets, op = F.coalesce((F.col("bs") < F.col("ee")) & (F.col("be") > F.col("es")), F.lit(False)), F.col("operation")
    goes = (
        F.when(op == "footnotes", meets).when(op == "epigraph", meets & (epigraph | notes)).when(op == "opening", meets & epigraph)
        .when(op == "body", (meets & (epigraph | notes)) | (epigraph & F.coalesce(F.col("be") > F.col("es"), F.lit(False)))).when(op == "clear_epigraph", epigraph).otherwise(F.lit(False))
    )
    fits = epigraph & (op == "attribution") & (F.col("bs") < F.col("es")) & (F.col("es") <= F.col("be"))
    rows = rows.withColumns({"goes": goes, "fits": fits})
    facts = {
        "last": F.max(F.when(epigraph, F.col("be"))), "left": F.max(F.when(epigraph & ~F.col("goes"), F.col("be"))), "lost": F.max(epigraph & F.col("goes")),
        "lost_note": F.max(notes & F.col("goes")), "found": F.min(F.when(F.col("fits"), F.col("nth"))), "covered": F.max(hole),
    }
    rows = rows.withColumns({n: f.over(all_of) for n, f in facts.items()})
    # an epigraph stands before the body: nothing but titles, the opening and other epigraphs before it; what lies between those is looked at
    begin = F.greatest("ss", "body_start")
    gap = F.when(F.col("own"), F.struct(F.greatest(begin, F.col("covered")).alias("a"), F.col("es").alias("z"))).when(epigraph & F.col("bs").isNotNull(), F.struct(F.greatest(begin, F.col("cover")).alias("a"), F.least("bs", "es").alias("z")))
    gaps = rows.where((op == "epigraph") & F.col("ss").isNotNull() & F.col("es").isNotNull()).select(*key, "title_position", gap.alias("gap")).select(*key, "title_position", "gap.*").where("a < z")
    stray = elements.where("type <> 'Title'").select("book_id", "pos").join(gaps, "book_id").where("pos >= a and pos < z and not (pos <=> title_position)")
    rows = rows.join(stray.select(*key, F.lit(True).alias("stray")).distinct(), key, "left")
    ranged = op != "clear_epigraph"
    problem = (
        F.when(~F.coalesce(op.isin(*OPERATIONS), F.lit(False)), "operation").when(F.col("ss").isNull(), "section")
        .when(ranged & ~F.coalesce((F.col("es") < F.col("ee")) & (F.col("es") >= F.col("ss")) & (F.col("ee") <= F.col("se")), F.lit(False)), "range")
        .when(ranged & F.coalesce(F.col("title_position").between(F.col("es"), F.col("ee") - 1), F.lit(False)), "title")
        .when(F.col("stray"), "not an opening").when((op == "attribution") & F.col("found").isNull(), "no epigraph")
    )
    rows = rows.withColumn("problem", problem)
    ok = F.col("edited") & F.col("problem").isNull()
    first = F.col("ss") + F.coalesce((F.col("title_position") == F.col("ss")).cast("int"), F.lit(0))
    body = (
        F.when(op == "epigraph", F.greatest("left", "ee")).when(op == "attribution", F.greatest(F.coalesce(F.nullif(F.col("body_start"), F.lit(0)), F.col("ee")), F.col("ee")))
        .when(op == "opening", F.greatest("ee", "left")).when((op == "body") & ~F.coalesce(F.col("lost_note"), F.lit(False)), F.col("es"))
        .when((op == "footnotes") & F.col("lost") & (F.col("body_start") == F.col("last")), F.greatest(first, F.col("left")))
        .when(op == "clear_epigraph", F.least(first, F.col("se"))).otherwise(F.col("body_start"))
    )
    moved = F.when(ok, body).otherwise(F.col("s.body_start")).cast(dict(sections.dtypes)["body_start"])
    new_sections = rows.where("s is not null").select(*[moved.alias(c) if c == "body_start" else F.col(f"s.{c}").alias(c) for c in sections.columns])
    new_sections = new_sections.unionByName(sections.where("book_id is null or id is null"))
    named = ok & F.coalesce(F.col("fits") & (F.col("nth") == F.col("found")), F.lit(False))
    changed = {"end": F.when(named, F.greatest("be", "ee")).otherwise(F.col("be")), "attribution_start": F.when(named, F.col("es")).otherwise(F.col("b.attribution_start"))}
    made = {
        "book_id": F.col("book_id"), "section_id": F.col("section_id"), "id": block_id(F.col("book_id").cast("string"), op, F.col("section_id").cast("string"), F.col("es"), F.col("ee")),
        "role": op, "start": F.col("es"), "end": F.col("ee"),
    }
    is_made = F.col("own") & op.isin("epigraph", "footnotes")
    blocks_now = rows.where((F.col("b").isNotNull() & ~(ok & F.col("goes"))) | (ok & is_made))
    either = lambda c, kind: F.when(F.col("b").isNotNull(), changed.get(c, F.col(f"b.{c}"))).otherwise(made.get(c, F.lit(None))).cast(kind).alias(c)
    new_blocks = blocks_now.select(*[either(c, kind) for c, kind in blocks.dtypes]).unionByName(blocks.where(loose))
    return new_sections, new_blocks, rows.where("own and problem is not null").select(*key, "problem")


def split_sections(sections: DataFrame, cuts: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, faults) after sections are cut at cuts(book_id, id, at), which lie strictly inside them and inside no other's range.

    sections(book_id, id, start, end, level, role, title, title_position), elements(book_id, pos, text). A work keeps its row and gets
    chapters a level down; other sections become their parts. Parts after the first take a short first element as title."""
    key = ["book_id", "id"]
    own = cuts.distinct().join(sections.select(*key, "start", "end", "level", "role"), key, "left")
    others = sections.select("book_id", F.col("id").alias("oid"), F.col("start").alias("os"), F.col("end").alias("oe"))
    meets = own.join(others, "book_id").where("(oid <> id or role = 'work') and (os = at or (start < os and os < end and (oe is null or (os < at and at < oe))))")
    crossing = meets.select(*key, F.lit("crosses a section").alias("problem")).distinct()
    problem = F.when(F.col("start").isNull(), "unknown section").when(F.col("end").isNull(), "no end").when(~((F.col("at") > F.col("start")) & (F.col("at") < F.col("end"))), "outside")
    faults = own.withColumn("problem", problem).where("problem is not null").select(*key, "problem").unionByName(crossing).distinct()
    points = cuts.distinct().join(faults.select(*key), key, "left_anti").groupBy(*key).agg(F.array_sort(F.collect_set("at")).alias("points"))  # as many as one person types
    both = sections.join(points, key)
    bounds = F.concat(F.array("start"), F.col("points"), F.array("end"))
    parts = both.withColumn("bounds", bounds).select("*", F.posexplode("points").alias("__k", "__p")).select("*", (F.col("__k") + 1).alias("k")).unionByName(both.withColumn("bounds", bounds).withColumns({"__k": F.lit(-1), "__p": F.col("start"), "k": F.lit(0)}))
    parts = parts.withColumns({"start": F.get("bounds", F.col("k")), "end": F.get("bounds", F.col("k") + 1), "work": F.col("role") == "work"})
    heads = elements.select("book_id", F.col("pos").alias("start"), F.trim("text").alias("heading"))
    parts = parts.join(heads, ["book_id", "start"], "left")
    headed = F.length("heading").between(1, HEADING)
    own_title = (F.col("k") == 0) & ~F.col("work") & ~F.coalesce(F.col("title_position") >= F.col("end"), F.lit(False))
    title = F.when(own_title, F.col("title")).when((F.col("k") > 0) & headed, F.col("heading"))
    place = F.when(own_title, F.col("title_position")).when((F.col("k") > 0) & headed, F.col("start"))
    named = F.when((F.col("k") == 0) & ~F.col("work"), F.col("id")).otherwise(F.concat_ws(":", "id", "start"))
    made = parts.withColumns({"title": title, "title_position": place.cast(dict(sections.dtypes)["title_position"]), "id": named, "level": F.when(F.col("work"), F.col("level") + 1).otherwise(F.col("level")).cast(dict(sections.dtypes)["level"]), "role": F.when(F.col("work"), "chapter").otherwise(F.col("role"))}).select(*sections.columns)
    stays = sections.join(points.select(*key), key, "left_anti").unionByName(sections.join(points.select(*key), key, "left_semi").where("role = 'work'"))
    return stays.select(*sections.columns).unionByName(made), faults


def history(versions: DataFrame, by: list[str], order: str, keep: int = HISTORY) -> DataFrame:
    """versions with ``back``: how many steps lead back to a version; those more than ``keep`` steps back are gone."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))) - 1
    return versions.withColumn("back", back).where(F.col("back") <= keep)


def undone(versions: DataFrame, by: list[str], order: str) -> DataFrame:
    """The version before the last of each structure; one without an earlier version is missing."""
    return history(versions, by, order).where("back = 1").drop("back")


def review_items(issues: DataFrame, sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """(book_id, n, message, section_id, position, end_position, block_type) of issues(book_id, n, message).

    The section is the innermost that begins where the message says, or holds the position it names; without a position it is
    where the section's first epigraph, body or text begins. sections(book_id, id, start, end, level, title_position, body_start)."""
    number = lambda pattern: F.nullif(F.regexp_extract("message", pattern, 1), F.lit("")).cast("int")
    rows = issues.withColumns({"begins": number(_START_OF), "target": number(_POSITION)})
    s = sections.select(F.col("book_id").alias("sb"), F.col("id").alias("section_id"), F.col("start").alias("ss"), F.col("end").alias("se"), "level", "title_position", "body_start")
    named = rows.join(s, (F.col("book_id") == F.col("sb")) & ((F.col("begins") == F.col("ss")) | ((F.col("target") >= F.col("ss")) & (F.col("se").isNull() | (F.col("target") < F.col("se"))))), "left")
    w = Window.partitionBy("book_id", "n").orderBy(F.desc(F.coalesce(F.col("begins") == F.col("ss"), F.lit(False))), F.desc("level"), "section_id")
    one = named.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "sb")
    b = blocks.select("book_id", "section_id", "role", F.col("start").alias("bs"), F.col("end").alias("be"), "attribution_start")
    opening = b.where("role = 'epigraph'").groupBy("book_id", "section_id").agg(F.min("bs").alias("opening"))
    one = one.join(opening, ["book_id", "section_id"], "left").withColumn("target", F.coalesce("target", "opening", "body_start", "ss"))
    hit = one.join(b.withColumnsRenamed({"book_id": "b2", "section_id": "s2"}), (F.col("book_id") == F.col("b2")) & (F.col("section_id") == F.col("s2")) & (F.col("target") >= F.col("bs")) & (F.col("target") < F.col("be")), "left")
    hit = hit.withColumn("r", F.row_number().over(Window.partitionBy("book_id", "n").orderBy("bs"))).where("r = 1")
    heading, source = F.col("target") == F.col("title_position"), (F.col("role") == "epigraph") & (F.col("target") >= F.col("attribution_start"))
    kind = (
        F.when(F.col("section_id").isNull() | F.col("target").isNull(), "unknown").when(heading, "heading").when(source, "attribution").when(F.col("role") == "epigraph", "epigraph")
        .when(F.col("role") == "footnotes", "attribution").when(F.col("role").isNotNull(), "unknown").when(F.col("target") >= F.col("body_start"), "body").otherwise("opening")
    )
    plain = F.coalesce(heading, F.lit(False)) | F.col("role").isNull()
    start = F.when(plain, F.col("target")).when(F.coalesce(source, F.lit(False)), F.col("attribution_start")).otherwise(F.col("bs"))
    return hit.select("book_id", "n", "message", "section_id", start.alias("position"), F.when(plain, F.col("target") + 1).otherwise(F.col("be")).alias("end_position"), kind.alias("block_type"))


def reader_view(elements: DataFrame, sections: DataFrame, blocks: DataFrame, merges: DataFrame) -> DataFrame:
    """(book_id, first, last, role, text): what a reader sees, elements in the groups of merges(book_id, start, end), each with its role.

    elements(book_id, pos, text), sections(book_id, id, title_position), blocks(book_id, role, start, end, attribution_start). A group
    has the role of its first element: heading, epigraph, attribution, footnotes or body."""
    titles = sections.where("title_position is not null").select("book_id", F.col("title_position").alias("pos"), F.lit("heading").alias("title")).distinct()
    spread = blocks.where(F.col("role") != "body").select("book_id", F.when((F.col("role") == "epigraph"), F.col("attribution_start")).alias("source"), "role", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    marks = spread.select("book_id", "pos", F.when(F.col("pos") >= F.col("source"), "attribution").otherwise(F.col("role")).alias("mark")).dropDuplicates(["book_id", "pos"])
    groups = merges.select("book_id", F.col("start").alias("group"), F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    rows = elements.join(titles, ["book_id", "pos"], "left").join(marks, ["book_id", "pos"], "left").join(groups, ["book_id", "pos"], "left")
    rows = rows.select("book_id", "pos", "text", F.coalesce("title", "mark", F.lit("body")).alias("role"), F.coalesce("group", "pos").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy("book_id", "first").agg(F.max("pos").alias("last"), F.min_by("role", "pos").alias("role"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def read_text(books: DataFrame, ranges: DataFrame, limit: int) -> DataFrame:
    """(book_id, start_char, text, next_start) for ranges(book_id, start_char, end_char): at most ``limit`` characters, and where to go on."""
    if not 1 <= limit <= 50_000:
        raise ValueError("limit must be 1 to 50000")
    rows = ranges.join(books.select("book_id", "text"), "book_id").withColumn("until", F.least(F.col("end_char"), F.length("text")))
    n = F.least(F.lit(limit), F.greatest(F.lit(0), F.col("until") - F.col("start_char")))
    return rows.select("book_id", "start_char", F.substring("text", (F.col("start_char") + 1).cast("int"), n.cast("int")).alias("text"), F.when(F.col("start_char") + n < F.col("until"), F.col("start_char") + n).alias("next_start"))


def readable_scenes(layers: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scenes in reading order whose layer isn't stale or failed."""
    return scenes.join(layers.where(F.col("status").isin("ready", "partial")).select("book_id", "chapter_id"), ["book_id", "chapter_id"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("book_id", "chapter_id").orderBy("start_char", "end_char", "id")))


def outline(sections: DataFrame, layers: DataFrame) -> DataFrame:
    """sections with ``scene_status``: that of their layer, not_started without one."""
    l = layers.select("book_id", F.col("chapter_id").alias("id"), F.col("status").alias("scene_status"))
    return sections.join(l, ["book_id", "id"], "left").withColumn("scene_status", F.coalesce("scene_status", F.lit("not_started")))


def without_scene_text(sections: DataFrame, elements: DataFrame, blocks: DataFrame) -> DataFrame:
    """(book_id, id) of sections(book_id, id, body_start, body_end) whose body has only blank elements or epigraphs and notes."""
    inside = elements.join(sections.select("book_id", F.col("id").alias("section_id"), "body_start", "body_end"), "book_id").where("pos >= body_start and pos < body_end").where(F.trim("text") != "")
    holes = blocks.where(F.col("role").isin("epigraph", "footnotes")).select("book_id", "section_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    full = inside.join(holes, ["book_id", "section_id", "pos"], "left_anti").select("book_id", F.col("section_id").alias("id")).distinct()
    return sections.select("book_id", "id").join(full, ["book_id", "id"], "left_anti")
