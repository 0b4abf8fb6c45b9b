"""Elements, sections and content blocks of books, as tables.

Tables follow one rule: a book's canonical text is its elements joined by line breaks, and everything
else is a half-open range of it. Per-book trees are small, so the few order-dependent steps run grouped by book.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import intervals

# Roles of sections, outermost first, and which may stand directly in which.
ROLES = ("book", "work", "volume", "part", "chapter", "section", "subsection", "paragraph")
#: Levels of a tree that one recursive query follows.
DEEPEST = 10_000


def elements(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, element) for each line of each text."""
    return texts.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "element"))


def element_offsets(lines: DataFrame, key: str) -> DataFrame:
    """(key, pos, start_char, end_char) of elements on the canonical text; only lengths are shuffled."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sized = lines.select(key, "pos", F.length("element").cast("long").alias("n"))
    start = F.coalesce(F.sum(F.col("n") + 1).over(order), F.lit(0)).cast("long")
    return sized.select(key, "pos", start.alias("start_char"), (start + F.col("n")).alias("end_char"))


def canonical_text(lines: DataFrame, key: str) -> DataFrame:
    """(key, text): elements joined by line breaks in order of position."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "element")))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["element"]), "\n").alias("text"))


def next_bound(sections: DataFrame, by: str = "book_id") -> DataFrame:
    """sections(start, level, total) with ``end``: the next start after its own of a section of the same or an outer level, or ``total``.

    Levels are any numbers. Each book's sections come sorted, in Arrow batches, from the last start to the first; a stack holds the starts that
    may still end a section, one a level at most, so a book is never a group in memory. A section without start or level ends at ``total``
    and ends nothing."""
    rows = sections.drop("end")
    names = rows.columns
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + ", `end` bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, stack, outer, here = object(), [], None, None  # stack: (level, start), nearer and deeper ones later; outer: least level at the start ``here``
        for b in batches:
            ends = []
            for key, start, level, total in zip(*(b.column(names.index(c)).to_pylist() for c in (by, "start", "level", "total")), strict=True):
                if key != book:
                    book, stack, outer, here = key, [], None, None
                if start is None or level is None:
                    ends.append(total)
                    continue
                if start != here:
                    if outer is not None:
                        while stack and stack[-1][0] >= outer:
                            stack.pop()  # hidden by a nearer start of an outer level
                        stack.append((outer, here))
                    outer, here = level, start
                outer = min(outer, level)
                ends.append(next((at for x, at in reversed(stack) if x <= level), total))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.int64())], [*names, "end"])

    dealt = rows.repartition(F.col(by)).sortWithinPartitions(F.col(by), F.col("start").desc_nulls_last())
    return dealt.mapInArrow(run, schema)


def closure(edges: DataFrame, roots: DataFrame, node: str = "id", parent: str = "parent_id", by: tuple[str, ...] = (), depth: int | None = None) -> DataFrame:
    """Descendants of the roots, themselves included, however deep, or at most ``depth`` levels down: (by, root, node, level), once each.

    A recursive query: each step joins the nodes of the last level with their children, by a shuffle, for a broadcast would send all edges
    through the driver at every level. ``by`` are columns within which an id is known. A node that
    a way has passed already isn't followed again, so circles end. A way of more than DEEPEST levels is an error, never cut off in silence."""
    spark = edges.sparkSession
    # Spark stops a recursion of more rows than this by default; here they are at most the ways from the roots
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    keys, of = "".join(f"`{k}`, " for k in by), lambda t: "".join(f"{t}.`{k}`, " for k in by)
    same = "".join(f" AND e.`{k}` = c.`{k}`" for k in by)
    stop = "" if depth is None else f" AND c.level < {int(depth)}"
    text = f"""WITH RECURSIVE c ({keys}root, `{node}`, level, way) MAX RECURSION LEVEL {DEEPEST} AS (
  SELECT {keys}`{node}`, `{node}`, 0, array(`{node}`) FROM {{roots}}
  UNION ALL
  SELECT /*+ MERGE(e) */ {of("c")}c.root, e.`{node}`, c.level + 1, array_append(c.way, e.`{node}`) FROM c JOIN {{edges}} AS e ON e.`{parent}` = c.`{node}`{same}{stop} WHERE NOT array_contains(c.way, e.`{node}`))
SELECT {keys}root, `{node}`, min(level) AS level FROM c GROUP BY {keys}root, `{node}`"""
    return spark.sql(text, edges=edges, roots=roots)


def ancestor(paths: Column, up: Column | int) -> Column:
    """The ancestor ``up`` levels above the last of a path of ids from the root; the root if there are fewer."""
    n = F.size(paths)
    return F.element_at(paths, F.greatest(F.lit(1), n - up).cast("int"))


def searchable(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """(section_id, start_char, end_char): bodies of sections without their epigraph and footnote blocks."""
    holes = blocks.where(F.col("role").isin("epigraph", "footnotes")).select("section_id", "start_char", "end_char")
    return intervals.subtract(sections.select(F.col("id").alias("section_id"), "start_char", "end_char"), holes, ["section_id"])


def content_blocks(lines: DataFrame, sections: DataFrame, notes: DataFrame) -> DataFrame:
    """(section_id, role, text): per section the body without the elements of its notes, and the notes themselves.

    lines(book_id, pos, element), sections(book_id, id, body_start, body_end), notes(book_id, section_id, role, start, end)."""
    inside = lines.join(sections, "book_id").where("pos >= body_start and pos < body_end").select("book_id", F.col("id").alias("section_id"), "pos", "element")
    n = notes.select("book_id", "section_id", "role", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    marked = inside.join(n, ["book_id", "section_id", "pos"], "left").withColumn("role", F.coalesce("role", F.lit("body")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "element")))
    return marked.groupBy("book_id", "section_id", "role").agg(F.array_join(F.transform(ordered, lambda x: x["element"]), "\n").alias("text"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def runs(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Maximal runs of neighbouring rows with one value: (by, value, first, last, n)."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.lag(order).over(w) == F.col(order) - 1), 0).otherwise(1)
    marked = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, value, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__run")


def section_violations(sections: DataFrame) -> DataFrame:
    """(book_id, id, problem) of sections with wrong bounds, levels, roles, parents or repeated ids."""
    s = sections
    bad = F.when(~(F.col("start") >= 0), "bounds").when(F.col("end").isNotNull() & (F.col("end") <= F.col("start")), "bounds").when(~F.col("level").between(0, 9), "level").when(~F.col("role").isin(*ROLES), "role")
    own = s.select("book_id", "id", bad.alias("problem")).where("problem is not null")
    twice = s.groupBy("book_id", "id").count().where("count > 1").select("book_id", "id", F.lit("repeated id").alias("problem"))
    p = s.select("book_id", F.col("id").alias("parent_id"), F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("level").alias("pl"))
    linked = s.where("parent_id is not null").join(p, ["book_id", "parent_id"], "left")
    outside = linked.where("ps is null or start < ps or (pe is not null and end > pe) or level <= pl").select("book_id", "id", F.lit("parent").alias("problem"))
    return own.unionByName(twice).unionByName(outside)


def stale(layers: DataFrame, current: DataFrame, by: str = "chapter_id") -> DataFrame:
    """Layers whose input hash isn't the current one, or whose input is gone: (by, state)."""
    both = layers.select(by, F.col("input_hash").alias("had")).join(current.select(by, F.col("input_hash").alias("now")), by, "left")
    return both.select(by, F.when(F.col("now").isNull(), "gone").when(F.col("had") != F.col("now"), "stale").otherwise("current").alias("state"))


def override(automatic: DataFrame, human: DataFrame, suppressed: DataFrame, keys: list[str]) -> DataFrame:
    """Automatic rows replaced by human ones of the same key, less suppressed keys; column ``origin`` tells which."""
    a = automatic.join(human.select(*keys), keys, "left_anti").join(suppressed.select(*keys), keys, "left_anti")
    return a.withColumn("origin", F.lit("automatic")).unionByName(human.withColumn("origin", F.lit("human")))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """(key, n) of keys that aren't unique."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
