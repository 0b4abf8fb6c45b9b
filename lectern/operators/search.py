"""Channels, rank fusion, clipping, ordering, paging, merging, projection and verdicts of searches.

Every channel is a frame of hits (search_id, channel, rank, id, start_char, end_char, ...), ranks from 1. What
follows is shared by all channels and works for many searches at once, partitioned by search_id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import spans
from lectern.operators import intervals

RRF = 60
STATUSES = ("relevant", "uncertain", "rejected", "unreviewed")


def ranked(hits: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """hits with ``rank`` from 1 in the given order."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def rrf(rank: Column) -> Column:
    return F.lit(1.0) / (rank + RRF)


def fuse(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, scores map, score): the best rank of each channel as 1/(60+rank), and their sum."""
    best = hits.groupBy(*by, "channel").agg(rrf(F.min("rank")).alias("s"))
    pairs = F.array_sort(F.collect_list(F.struct("channel", "s")))
    fused = best.groupBy(*by).agg(pairs.alias("p"))
    return fused.select(*by, F.map_from_entries("p").alias("scores"), F.aggregate("p", F.lit(0.0), lambda a, x: a + x["s"]).alias("score"))


#: Ranges of a scope that every task may hold.
STATED = 1000


def clip_to_ranges(hits: DataFrame, ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hits cut to each allowed range (by, start_char, end_char) that they meet; empty pieces go."""
    by = by or []
    r = ranges.select(*by, F.col("start_char").alias("__s"), F.col("end_char").alias("__e"))
    if by:
        both = hits.join(r, by)
    elif ranges.limit(STATED + 1).count() <= STATED:
        both = hits.crossJoin(F.broadcast(r))  # a stated scope of at most STATED ranges
    else:  # met in buckets of places
        pairs = intervals.overlap_join(hits.withColumn("__k", F.lit(0)), ranges.withColumn("__k", F.lit(0)), ["__k"], 4096, ("", "__r_"))
        both = pairs.withColumnsRenamed({"__r_start_char": "__s", "__r_end_char": "__e"}).select(*hits.columns, "__s", "__e")
    return both.withColumns({"start_char": F.greatest("start_char", "__s"), "end_char": F.least("end_char", "__e")}).where("start_char < end_char").drop("__s", "__e")


def candidates(hits: DataFrame, ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Clipped hits joined by their place: id start:end, best score of each channel, scenes, path and anchors inside."""
    cut = clip_to_ranges(hits, ranges, by)
    keys = ["search_id", "start_char", "end_char"]
    scored = fuse(cut, keys)
    inside = (F.col("anchor_start") >= F.col("start_char")) & (F.col("anchor_start") < F.col("anchor_end")) & (F.col("anchor_end") <= F.col("end_char"))
    more = cut.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("origin") == "scene", F.col("id")))).alias("scene_ids"),
        F.min_by("path", F.when(F.col("path").isNotNull(), F.struct("channel", "rank"))).alias("path"),
        F.array_sort(F.collect_set(F.when(inside, F.struct(F.col("anchor_start").alias("start_char"), F.col("anchor_end").alias("end_char"))))).alias("anchors"),
    )
    return scored.join(more, keys).withColumn("id", F.concat_ws(":", "start_char", "end_char"))


def round_robin(items: DataFrame) -> DataFrame:
    """items(search_id, id, scores map) with ``ord`` from 0: channels in the order of their names take turns, each
    gives its best item that isn't out yet. Sequential by nature, so grouped by search."""

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        queues: dict[str, list] = {}
        for at, (item, scores) in enumerate(zip(pdf["id"], pdf["scores"], strict=True)):
            for channel, score in dict(scores).items():
                queues.setdefault(channel, []).append((round(1 / score) - RRF, at, item))
        lines = [iter(sorted(q)) for _, q in sorted(queues.items())]
        out: dict = {}
        while lines:
            alive = []
            for line in lines:
                new = next((item for _, _, item in line if item not in out), None)
                if new is not None:
                    out[new] = len(out)
                    alive.append(line)
            lines = alive
        return pd.DataFrame({"search_id": pdf["search_id"].iloc[0], "id": list(out), "ord": list(out.values())})

    kinds = dict(items.dtypes)
    order = items.select("search_id", "id", "scores").groupBy("search_id").applyInPandas(turn, f"search_id {kinds['search_id']}, id {kinds['id']}, ord long")
    return items.join(order, ["search_id", "id"])


def page(items: DataFrame, offset: int = 0, size: int = 10, status: str | None = None) -> DataFrame:
    """The next ``size`` items with ord >= offset (of one review status, if given) of each search, with next_offset.

    next_offset is null when nothing follows."""
    if not 1 <= size <= 50:
        raise ValueError("size must be 1 to 50")
    rest = items.where(F.col("ord") >= offset)
    if status is not None:
        rest = rest.where(F.col("review_status") == status)
    w = Window.partitionBy("search_id").orderBy("ord")
    probe = rest.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= size + 1)
    more = F.max("__n").over(Window.partitionBy("search_id")) > size
    last = F.max(F.when(F.col("__n") <= size, F.col("ord"))).over(Window.partitionBy("search_id"))
    return probe.withColumn("next_offset", F.when(more, last + 1)).where(F.col("__n") <= size).drop("__n")


def review_counts(items: DataFrame) -> DataFrame:
    """One row for each search: how many items have each status, zeros included."""
    return items.groupBy("search_id").agg(*[F.sum((F.col("review_status") == s).cast("long")).alias(s) for s in STATUSES])


def merged_status(statuses: Column) -> Column:
    """None but unreviewed: unreviewed; one kind else: that; several: uncertain."""
    kinds = F.array_distinct(F.filter(statuses, lambda s: s != "unreviewed"))
    return F.when(F.size(kinds) == 0, "unreviewed").when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("uncertain")


def merge_searches(items: DataFrame) -> DataFrame:
    """Items (search_no, id, scores, review_status, selected, viewed) of several searches, one row for each id.

    Scores are the largest of each channel; flags are or-ed in the order of searches; selection falls at a
    conflict of verdicts and with a rejection."""
    pairs = items.select("id", F.explode("scores").alias("channel", "s")).groupBy("id", "channel").agg(F.max("s").alias("s")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "s")))).alias("scores"))
    rows = items.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("search_no", "review_status", "selected"))).alias("r"), F.max("viewed").alias("viewed"))
    start = F.struct(F.lit("unreviewed").alias("status"), F.lit(False).alias("selected"))

    def step(a, x):
        clash = (a["status"] != "unreviewed") & (x["review_status"] != "unreviewed") & (a["status"] != x["review_status"])
        status = F.when(clash, "uncertain").when(a["status"] == "unreviewed", x["review_status"]).otherwise(a["status"])
        return F.struct(status.alias("status"), ((a["selected"] | x["selected"]) & ~clash & (status != "rejected")).alias("selected"))

    folded = rows.withColumn("f", F.aggregate("r", start, step))
    return folded.select("id", F.col("f.status").alias("review_status"), F.col("f.selected").alias("selected"), "viewed").join(pairs, "id", "left")


def project(items: DataFrame, chunks: DataFrame, width: int = 2000) -> DataFrame:
    """Passages (chunk ranges) that overlap candidates inherit each channel's best score: (search_id, start, end, channel, score).

    items(search_id, book_id, start_char, end_char, channel, score), chunks(book_id, start_char, end_char)."""
    pairs = intervals.overlap_join(items, chunks, ["book_id"], width)
    return pairs.groupBy(F.col("left_search_id").alias("search_id"), "book_id", F.col("right_start_char").alias("start_char"), F.col("right_end_char").alias("end_char"), F.col("left_channel").alias("channel")).agg(F.max("left_score").alias("score"))


def annotate_sections(items: DataFrame, sections: DataFrame, width: int = 5000) -> DataFrame:
    """items(book_id, id, ...) with the ids of the sections that they overlap, in section order."""
    pairs = intervals.overlap_join(items.select("book_id", "id", "start_char", "end_char"), sections.select("book_id", "id", "start_char", "end_char"), ["book_id"], width)
    found = pairs.groupBy("book_id", F.col("left_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("right_start_char", "right_end_char", "right_id"))), lambda x: x["right_id"]).alias("section_ids"))
    return items.join(found, ["book_id", "id"], "left")


def apply_verdicts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """items(id, text, start_char) joined with verdicts(id, status, reason, evidence, seq): the last verdict counts, all are kept.

    For relevant and uncertain ones the quote is the sentences that hold the evidence, else the whole item."""
    v = verdicts.where(F.col("status").isin(*STATUSES[:3])).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "status", "reason", "evidence"))).alias("history"))
    both = items.join(v, "id", "left").withColumn("last", F.try_element_at("history", F.lit(-1)))
    both = both.withColumn("span", spans.evidence_span(F.col("text"), F.col("last.evidence")))
    kept = F.col("last.status").isin("relevant", "uncertain")
    found = kept & F.col("span.start_char").isNotNull()
    start = F.when(found, F.col("start_char") + F.col("span.start_char")).when(kept, F.col("start_char"))
    end = F.when(found, F.col("start_char") + F.col("span.end_char")).when(kept, F.col("start_char") + F.length("text"))
    return both.select(
        "id", F.coalesce("last.status", F.lit("unreviewed")).alias("review_status"), F.trim(F.coalesce("last.reason", F.lit(""))).alias("reason"),
        F.coalesce(kept, F.lit(False)).alias("selected"), F.coalesce(found, F.lit(False)).alias("verified"), start.alias("quote_start"), end.alias("quote_end"),
        F.substring("text", (start - F.col("start_char") + 1).cast("int"), (end - start).cast("int")).alias("quote"), F.transform("history", lambda h: F.struct(h["status"], h["reason"])).alias("review_history"),
    )


def neighbours(scenes: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """Scenes(book_id, id, scene_rank) up to ``before`` places before or ``after`` places after an anchor (book_id, id)."""
    near = anchors.join(scenes.select("book_id", "id", "scene_rank"), ["book_id", "id"]).select("book_id", F.col("id").alias("anchor_id"), "scene_rank")
    want = near.select("book_id", "anchor_id", F.explode(F.sequence(F.col("scene_rank") - before, F.col("scene_rank") + after)).alias("scene_rank"), F.col("scene_rank").alias("own")).where("scene_rank <> own")
    return want.join(scenes, ["book_id", "scene_rank"]).select("book_id", "anchor_id", "id", (F.col("scene_rank") - F.col("own")).alias("distance"))


def within_hops(scenes: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """Scenes within ``hops`` of the nearest anchor along the reading order: (book_id, id, distance)."""
    near = neighbours(scenes, anchors, hops, hops).select("book_id", "id", F.abs("distance").alias("distance"))
    return near.unionByName(anchors.select("book_id", "id", F.lit(0).alias("distance"))).groupBy("book_id", "id").agg(F.min("distance").alias("distance"))


def both_ways(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Edges and their reverses."""
    return edges.unionByName(edges.withColumns({source: F.col(target), target: F.col(source)}))


def reading_chain(scenes: DataFrame, *order: str) -> DataFrame:
    """scenes(book_id, id) with scene_rank from 1, previous_id and next_id in reading order."""
    w = Window.partitionBy("book_id").orderBy(*order, "id")
    return scenes.withColumns({"scene_rank": F.row_number().over(w).cast("long"), "previous_id": F.lag("id").over(w), "next_id": F.lead("id").over(w)})


def chunk_context(docs: DataFrame, key: str, tail: int = 200, head: int = 40) -> DataFrame:
    """Chunks of whole texts with their neighbours' starts, their heads and at most ``tail`` characters of what stands before."""
    found = docs.select(key, "text", F.posexplode(spans.chunks(F.col("text"))).alias("k", "c"), spans.chunks(F.col("text")).alias("all"))
    before, after = F.get("all", F.col("k") - 1), F.get("all", F.col("k") + 1)
    n = F.least(F.lit(tail), before["end_char"] - before["start_char"])
    end = F.coalesce(F.substring("text", before["end_char"] - n + 1, n), F.lit(""))
    long = lambda c: c.cast("long")
    return found.select(key, long(F.col("c.start_char")).alias("start_char"), long(F.col("c.end_char")).alias("end_char"), long(before["start_char"]).alias("previous_start"), long(after["start_char"]).alias("next_start"), F.substring("text", F.col("c.start_char") + 1, F.lit(head)).alias("head"), end.alias("tail_before"))
