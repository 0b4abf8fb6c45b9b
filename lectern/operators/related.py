"""Places related to fragments: by links between events, by links between scenes, by similarity; many fragments at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions import vectors as V
from lectern.operators import intervals, search, vectors

# What a link is called in a path.
LABELS = {"retells": "пересказ того же события", "prefigures": "предвестие", "causes": "связь по причине", "parallels": "параллель"}


def link_path(kind: Column, basis: Column, target: Column, reason: Column, scenes: bool = False) -> Column:
    """How a place was found: kind of link, level, hypothesis, target and reason."""
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), kind), kind)
    guess = F.when(basis == "suggestive", " (гипотеза)").otherwise("")
    tail = F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(" — "), reason)).otherwise("")
    return F.concat(label, F.lit(" между сценами" if scenes else ""), guess, F.lit(": «"), F.coalesce(target, F.lit("")), F.lit("»"), tail)


def _ranked(rows: DataFrame, channel: str, *order: Column | str) -> DataFrame:
    """rows with the channel and their rank in their fragment's order; one rank for each row."""
    w = Window.partitionBy("book_id", "fragment").orderBy(*order)
    return rows.select("book_id", "fragment", F.col("id").cast("string").alias("id"), "start_char", "end_char", F.lit(channel).alias("channel"), F.row_number().over(w).alias("rank"), "path")


def linked_events(fragments: DataFrame, events: DataFrame, links: DataFrame, chunks: DataFrame, width: int = 2000) -> DataFrame:
    """Chunks that contain an event linked, either way, to an event that a fragment(book_id, fragment, start_char, end_char) overlaps.

    events(book_id, id, start_char, end_char, gist), links(book_id, source_id, target_id, type, basis, reason), chunks(book_id, id, start_char, end_char)."""
    e = events.select("book_id", "id", "start_char", "end_char", "gist")
    met = intervals.overlap_join(fragments.select("book_id", "fragment", "start_char", "end_char"), e, ["book_id"], width).select("book_id", F.col("left_fragment").alias("fragment"), F.col("right_id").alias("source_id"))
    both = search.both_ways(links, "source_id", "target_id")
    to = met.join(both, ["book_id", "source_id"]).join(e.select("book_id", F.col("id").alias("target_id"), F.col("start_char").alias("a"), F.col("end_char").alias("b"), "gist"), ["book_id", "target_id"])
    to = to.withColumn("path", link_path(F.col("type"), F.col("basis"), F.col("gist"), F.col("reason"))).select("book_id", "fragment", F.col("a").alias("start_char"), F.col("b").alias("end_char"), "path").distinct()
    home = intervals.overlap_join(to, chunks.select("book_id", "id", "start_char", "end_char"), ["book_id"], width).where("right_start_char <= left_start_char and right_end_char >= left_end_char")
    rows = home.select("book_id", F.col("left_fragment").alias("fragment"), F.col("right_id").alias("id"), F.col("right_start_char").alias("start_char"), F.col("right_end_char").alias("end_char"), F.col("left_path").alias("path")).distinct()
    return _ranked(rows, "links", "start_char", "id", "path")


def linked_scenes(fragments: DataFrame, scenes: DataFrame, links: DataFrame, width: int = 5000) -> DataFrame:
    """Scenes linked, either way, to a scene that a fragment overlaps; links of another version of either text aren't read.

    scenes(book_id, id, start_char, end_char, title, text_hash), links(book_id, source_id, target_id, type, basis, reason, source_hash, target_hash)."""
    now = lambda end, digest: scenes.select("book_id", F.col("id").alias(end), F.col("text_hash").alias(digest))
    valid = links.join(now("source_id", "source_hash"), ["book_id", "source_id", "source_hash"], "left_semi").join(now("target_id", "target_hash"), ["book_id", "target_id", "target_hash"], "left_semi")
    both = search.both_ways(valid.select("book_id", "source_id", "target_id", "type", "basis", "reason"), "source_id", "target_id")
    s = scenes.select("book_id", "id", "start_char", "end_char")
    met = intervals.overlap_join(fragments.select("book_id", "fragment", "start_char", "end_char"), s, ["book_id"], width).select("book_id", F.col("left_fragment").alias("fragment"), F.col("right_id").alias("source_id"))
    to = met.join(both, ["book_id", "source_id"]).join(scenes.select("book_id", F.col("id").alias("target_id"), "start_char", "end_char", "title"), ["book_id", "target_id"])
    rows = to.select("book_id", "fragment", F.col("target_id").alias("id"), "start_char", "end_char", link_path(F.col("type"), F.col("basis"), F.col("title"), F.col("reason"), True).alias("path")).distinct()
    return _ranked(rows, "scenes", "start_char", "id", "path")


def _dealt(rows: DataFrame, key: str, block: int, mine: str, other: str, others: DataFrame) -> DataFrame:
    """rows in blocks (column ``mine``) of their book, once for each block of the others' (column ``other``)."""
    own = rows.groupBy("book_id").agg(F.ceil(F.count("*") / block).alias("n_own"))
    sized = rows.join(own, "book_id").join(others, "book_id")
    return sized.withColumns({mine: F.pmod(F.xxhash64(key), F.col("n_own")), other: F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_other") - 1))}).drop("n_own", "n_other")


def _similar(mine: DataFrame, chunks: DataFrame, k: int, few: int, many: int) -> DataFrame:
    """(book_id, fragment, id, start_char, end_char, score): each fragment's k best chunks of each block, by matrix products."""
    n = lambda rows, block: rows.groupBy("book_id").agg(F.ceil(F.count("*") / block).alias("n_other"))
    c = chunks.select("book_id", "id", "start_char", "end_char", "embedding", "embedding_model")
    left = _dealt(mine, "fragment", few, "fb", "cb", n(c, many))
    right = _dealt(c, "id", many, "cb", "fb", n(mine, few))
    kinds = dict(mine.dtypes) | dict(c.dtypes)
    names = ("book_id", "fragment", "id", "start_char", "end_char")
    schema = to_arrow_schema(mine.select("book_id", "fragment").join(c.select("book_id", "id", "start_char", "end_char"), "book_id").withColumn("score", F.lit(0.0)).schema)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        b = b.sort_by("id")
        x, y = vectors.unit_rows(a.column("v")), vectors.unit_rows(b.column("embedding"))
        at, until, start, end = (t.column(name).to_numpy() for t, name in ((a, "a"), (a, "b"), (b, "start_char"), (b, "end_char")))
        both = pa.chunked_array([*a.column("m").chunks, *b.column("embedding_model").chunks], type=a.column("m").type).combine_chunks()
        model = pc.rank(both, tiebreaker="dense").to_numpy()
        p, q = model[: a.num_rows], model[a.num_rows :]

        def score(i: slice, j: slice) -> np.ndarray:
            s = (1 + vectors.cosines((x[0][i], x[1][i]), (y[0][j], y[1][j]), -np.inf)) / 2
            s[(p[i][:, None] != q[j][None, :]) | (~(start[j][None, :] >= until[i][:, None]) & ~(end[j][None, :] <= at[i][:, None]))] = -np.inf
            return s

        r, c, s = vectors.best_columns(score, a.num_rows, b.num_rows, k)
        return pa.table([*(a.column(name).take(r) for name in names[:2]), *(b.column(name).take(c) for name in names[2:]), pa.array(np.round(s, 9))], names=[*names, "score"])

    on = ("book_id", "fb", "cb")
    right = right.withColumnsRenamed({name: f"{name}_r" for name in on})  # sides of one table have the same columns
    return left.groupBy(*on).cogroup(right.groupBy(*[f"{name}_r" for name in on])).applyInArrow(best, ", ".join(f"`{name}` {kinds[name]}" for name in names) + ", score double")


def similar_chunks(fragments: DataFrame, chunks: DataFrame, k: int = 5, width: int = 2000, blocks: tuple[int, int] = (4000, 20000)) -> DataFrame:
    """The k chunks of a book most similar to the smallest chunk that contains a fragment; it and those that overlap it are left out.

    chunks(book_id, id, start_char, end_char, embedding, embedding_model): vectors of one model and length are compared. A fragment meets
    the chunks of its own book only, in blocks of so many fragments and chunks, of which only each fragment's best k leave a task."""
    whole = chunks.where(V.valid(F.col("embedding")))
    named = fragments.select("book_id", "fragment", "start_char", "end_char").withColumn("key", F.struct("book_id", "fragment"))
    home = intervals.smallest_container(named, whole.select("book_id", "id", "start_char", "end_char"), ["book_id"], "key", width)
    mine = home.select("book_id", F.col("left_fragment").alias("fragment"), F.col("right_id").alias("id"), F.col("right_start_char").alias("a"), F.col("right_end_char").alias("b"))
    mine = mine.join(whole.select("book_id", "id", F.col("embedding").alias("v"), F.col("embedding_model").alias("m")), ["book_id", "id"]).drop("id")
    scored = _similar(mine, whole, k, *blocks).withColumn("path", F.lit("похожий по смыслу фрагмент"))
    return _ranked(scored, "similar", F.desc("score"), "id").where(F.col("rank") <= k)


def related(*channels: DataFrame) -> DataFrame:
    """(book_id, fragment, id, start_char, end_char, scores, score, path, nth): channels fused by place; the first path of a place stays."""
    every = channels[0]
    for c in channels[1:]:
        every = every.unionByName(c)
    best = every.groupBy("book_id", "fragment", "id", "start_char", "end_char", "channel").agg(F.max(search.rrf(F.col("rank"))).alias("s"), F.min(F.struct("rank", "path")).alias("p"))
    order = {"links": 0, "scenes": 1, "similar": 2}
    nth = F.try_element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("channel"))
    fused = best.groupBy("book_id", "fragment", "id", "start_char", "end_char").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "s")))).alias("scores"), F.sum("s").alias("score"), F.min(F.struct(nth.alias("n"), F.col("p.path").alias("path")))["path"].alias("path"))
    w = Window.partitionBy("book_id", "fragment").orderBy(F.desc("score"), "start_char", "id")
    return fused.withColumn("nth", F.row_number().over(w))
