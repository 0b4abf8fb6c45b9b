"""A book's search service over tables: channels, expansion, fusion, projection, review and retrieval plans.

Tables (DataFrames in a dict): books(book_id, text, revision, generation), sections(book_id, id, parent_id, title,
role, start_char, end_char), blocks(book_id, section_id, role, start_char, end_char), scenes(book_id, id,
start_char, end_char, title, summary, status, scene_rank, summary_embedding), chunks(book_id, id, scene_id, start_char,
end_char, text, embedding), presence(entity_id, scene_id), entities(id, canonical_name, aliases, entity_type,
scene_count), event_links and scene_links(source_id, target_id, type, basis, reason). Absent tables switch channels off.

A search is a frame of candidates (search_id, id, start_char, end_char, scores, score, ord, scene_ids, path,
anchors, review_status, selected, viewed) and small facts about it. Nothing is collected but single pages and flags.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import entities, fulltext, intervals, related, search, sessions, structure

SEARCHABLE = ("ready", "partial")
#: Candidates of one channel at most; a search says which channels had more.
MOST = 2000
EXPANSIONS = ("discourse", "composition", "character", "chronotope", "retelling", "prefiguring", "parallel", "causal")
_BY_TYPE = {"retelling": "retells", "prefiguring": "prefigures", "parallel": "parallels", "causal": "causes"}


def check(value: object, low: int, high: int, name: str) -> int:
    """A whole number (no boolean) in bounds."""
    if type(value) is not int or not low <= value <= high:
        raise ValueError(f"{name} must be {low} to {high}")
    return value


def check_query(text: str) -> str:
    """A query that isn't blank, of at most 1000 characters."""
    if not isinstance(text, str) or not text.strip() or len(text.strip()) > 1000:
        raise ValueError("a query of 1 to 1000 characters is needed")
    return text.strip()


def _settled(candidates: DataFrame) -> DataFrame:
    """The rows themselves, so that later steps of a conversation start from them and not from a growing plan.

    A search has at most MOST candidates of each channel."""
    return candidates.sparkSession.createDataFrame(candidates.collect(), candidates.schema)


@dataclass
class Result:
    """A search: its candidates in order, and what is known about it."""

    candidates: DataFrame
    search_id: str
    query: str
    revision: tuple
    truncated: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    parents: list[str] = field(default_factory=list)
    plan: dict | None = None


class Search:
    """Searches in one book."""

    def __init__(self, tables: dict[str, DataFrame], book_id: str):
        self.t, self.book_id = tables, book_id
        self.spark = tables["books"].sparkSession

    def _own(self, name: str) -> DataFrame:
        return self.t[name].where(F.col("book_id") == self.book_id)

    def revision(self) -> tuple:
        """(revision, generation) now; a search of another one is stale."""
        r = self._own("books").select("revision", "generation").first()
        if r is None:
            raise LookupError("no such book")
        return r.revision, r.generation

    def fresh(self, result: Result) -> None:
        if self.revision() != result.revision:
            raise sessions.Conflict("the book has changed since the search")

    def ranges(self, section_ids: list[str] | None = None) -> DataFrame:
        """Searchable ranges of the sections and what they hold: bodies less epigraphs and footnotes."""
        s = self._own("sections")
        if section_ids is not None:
            check(len(section_ids), 1, 200, "number of sections")
            known = s.where(F.col("id").isin(section_ids)).count()
            if known != len(set(section_ids)):
                raise ValueError("unknown section")
            inside = structure.closure(s, s.where(F.col("id").isin(section_ids))).select("id").distinct()
            s = s.join(inside, "id", "left_semi")
        leaves = s.join(s.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")
        return structure.searchable(leaves, self._own("blocks")).select("start_char", "end_char").distinct()

    def _scenes(self) -> DataFrame:
        return self._own("scenes").where(F.col("status").isin(*SEARCHABLE))

    def _limited(self, scored: DataFrame, ranges: DataFrame, limit: int) -> tuple[DataFrame, bool]:
        """The best hits inside the ranges, and whether there were more; filtered before the limit."""
        inside = intervals.overlap_join(scored.withColumn("k", F.lit(0)), ranges.withColumn("k", F.lit(0)), ["k"], 4096, ("", "r_")).dropDuplicates(["id"]).select(*scored.columns)
        probe = inside.orderBy(F.desc("score"), "id").limit(limit + 1)
        return probe.orderBy(F.desc("score"), "id").limit(limit), probe.count() > limit

    def _hits(self, rows: DataFrame, channel: str, origin: str) -> DataFrame:
        w = Window.orderBy(F.desc("score"), "id")  # at most candidate_limit rows
        have = set(rows.columns)
        extra = {"path": "string", "anchor_start": "long", "anchor_end": "long"}
        return rows.select(F.lit("").alias("search_id"), F.lit(channel).alias("channel"), F.row_number().over(w).alias("rank"), F.col("id").cast("string").alias("id"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), F.lit(origin).alias("origin"), *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in extra.items()])

    def _result(self, hits: list[DataFrame], ranges: DataFrame, query: str, truncated: list[str], warnings: list[str] | None = None, parents: list[str] | None = None) -> Result:
        every = hits[0]
        for h in hits[1:]:
            every = every.unionByName(h)
        sid = uuid.uuid4().hex
        found = search.candidates(every.withColumn("search_id", F.lit(sid)), ranges)
        return Result(self._finish(found), sid, query, self.revision(), truncated, warnings or [], parents or [])

    @staticmethod
    def _finish(found: DataFrame) -> DataFrame:
        ordered = search.round_robin(found)
        have = set(ordered.columns)
        defaults = {"review_status": F.lit("unreviewed"), "reason": F.lit(""), "selected": F.lit(False), "viewed": F.lit(False)}
        return _settled(ordered.withColumns({c: v for c, v in defaults.items() if c not in have}))

    def words(self, query: str, target: str = "text", section_ids: list[str] | None = None, limit: int = 200) -> Result:
        """Search by the stems of words in chunk texts, in titles and summaries of scenes, or in chunk contexts.

        Chunk texts are looked up in the stored index (tables postings and posting_stats); where there is none it is made for the search."""
        q, limit = check_query(query), check(limit, 1, 2000, "candidate_limit")
        if target == "scenes":
            docs, origin = self._scenes().withColumn("text", F.concat_ws(" ", "title", "summary")), "scene"
        elif target in ("text", "context"):
            docs, origin = self._own("chunks"), "chunk"
            if target == "context":
                if "context" not in docs.columns:
                    raise ValueError("the chunks have no contexts")
                docs = docs.withColumn("text", F.coalesce("context", F.lit("")))
        else:
            raise ValueError("target is text, scenes or context")
        r = self.ranges(section_ids)
        if target == "text" and {"postings", "posting_stats"} <= self.t.keys():
            blocks, stats = self._own("postings"), self._own("posting_stats")
        else:
            blocks, stats = fulltext.build(fulltext.postings(docs))
        asked = self.spark.createDataFrame([(self.book_id, w) for w in fulltext.query_tokens(q)], "book_id string, token string")
        hits, _ = fulltext.search(blocks, stats, asked, limit + 1, r.withColumn("book_id", F.lit(self.book_id)))
        more = hits.count() > limit
        best = hits.where(F.col("rank") <= limit).select("id", "start_char", "end_char", "score")
        return self._result([self._hits(best, f"words:{target}", origin)], r, q, [f"words:{target}"] * more)

    def semantic(self, query: str, vector: list[float], section_ids: list[str] | None = None, limit: int = 200) -> Result:
        """Search by a query's vector in chunks and scene summaries, fused."""
        q, limit = check_query(query), check(limit, 1, 2000, "candidate_limit")
        r, v = self.ranges(section_ids), F.array(*[F.lit(float(x)) for x in vector])
        hits, more = [], []
        for name, rows, column, origin in (("semantic", self._own("chunks"), "embedding", "chunk"), ("summaries", self._scenes(), "summary_embedding", "scene")):
            if column not in rows.columns:
                continue
            scored = rows.where(V.valid(F.col(column), len(vector))).select("id", "start_char", "end_char", V.similarity(F.col(column), v).alias("score"))
            best, cut = self._limited(scored, r, limit)
            hits.append(self._hits(best, name, origin))
            more += [name] * cut
        return self._result(hits, r, q, more)

    def find_entities(self, query: str | None = None, limit: int = 10, types: list[str] | None = None) -> DataFrame:
        """Entities by name, ``ambiguous`` when the best two are close; without a name those of the types in most scenes."""
        rows = self.t["entities"] if types is None else self.t["entities"].where(F.col("entity_type").isin(types))
        if not query:
            if not types:
                raise ValueError("a name or types are needed")
            listed = rows.select("id", F.lit(None).cast("double").alias("score"), "scene_count", F.lit(False).alias("ambiguous"))
            return listed.orderBy(F.desc("scene_count"), "id").limit(check(limit, 1, 30, "limit"))
        return entities.name_match(rows, check_query(query), check(limit, 1, 30, "limit"))

    def scenes_for_entities(self, ids: list, every: bool = True, section_ids: list[str] | None = None, limit: int = MOST) -> Result:
        """Scenes where all, or any, of the entities occur; of more than ``limit`` those with most of them."""
        check(len(ids), 1, 200, "number of entities")
        if self.t["entities"].where(F.col("id").isin(ids)).count() != len(set(ids)):
            raise ValueError("unknown entity")
        found = entities.scenes_with(self.t["presence"], ids, every)
        rows = self._scenes().join(found.select(F.col("scene_id").alias("id"), F.col("n").cast("double").alias("score")), "id").select("id", "start_char", "end_char", "score")
        r = self.ranges(section_ids)
        best, more = self._limited(rows, r, check(limit, 1, MOST, "candidate_limit"))
        return self._result([self._hits(best, "entity", "scene")], r, "", ["entity"] * more)

    def neighbours(self, scene_ids: list, before: int = 1, after: int = 1, limit: int = MOST) -> Result:
        """Scenes before and after given ones in reading order, the nearest ``limit`` of them."""
        check(before, 0, 10, "before"), check(after, 0, 10, "after")
        a = self._own("scenes").where(F.col("id").isin(scene_ids)).select("book_id", "id")
        near = search.neighbours(self._scenes(), a, before, after)
        rows = near.groupBy("id").agg((-F.min(F.abs("distance"))).cast("double").alias("score")).join(self._scenes().select("id", "start_char", "end_char"), "id")
        r = self.ranges()
        best, more = self._limited(rows, r, check(limit, 1, MOST, "candidate_limit"))
        return self._result([self._hits(best, "neighbors", "scene")], r, "", ["neighbors"] * more)

    def graph(self, scene_ids: list, hops: int = 1, limit: int = MOST) -> Result:
        """Scenes within some hops of given ones along the reading order, the nearest ``limit`` of them."""
        a = self._own("scenes").where(F.col("id").isin(scene_ids)).select("book_id", "id")
        near = search.within_hops(self._scenes(), a, check(hops, 0, 3, "hops"))
        rows = near.select("id", (-F.col("distance")).cast("double").alias("score")).join(self._scenes().select("id", "start_char", "end_char"), "id")
        r = self.ranges()
        best, more = self._limited(rows, r, check(limit, 1, MOST, "candidate_limit"))
        return self._result([self._hits(best, "graph", "scene")], r, "", ["graph"] * more)

    def expand(self, scene_ids: list, channels: list[str], limit: int = MOST) -> Result:
        """Scenes related to given ones by neighbourhood, section, shared entities, places or links, fused; at most ``limit`` of each channel."""
        r, limit, more = self.ranges(), check(limit, 1, MOST, "candidate_limit"), []
        if not channels or set(channels) - set(EXPANSIONS):
            raise ValueError(f"channels are {', '.join(EXPANSIONS)}")
        own = self._scenes()
        a = own.where(F.col("id").isin(scene_ids))
        place = own.select("id", "start_char", "end_char")
        hits, warnings = [], []
        for c in channels:
            if c == "discourse":
                rows = search.neighbours(own, a.select("book_id", "id"), 2, 2).groupBy("id").agg((-F.min(F.abs("distance"))).cast("double").alias("score"))
            elif c == "composition":
                s = self._own("sections")
                home = intervals.smallest_container(a.select("book_id", "id", "start_char", "end_char"), s.select("book_id", F.col("id").alias("sid"), "start_char", "end_char"), ["book_id"], "id", 4096)
                up = home.select("book_id", F.col("right_start_char").alias("start_char"), F.col("right_end_char").alias("end_char")).distinct()
                rows = intervals.overlap_join(own.select("book_id", "id", "start_char", "end_char"), up, ["book_id"], 4096).groupBy(F.col("left_id").alias("id")).agg(F.lit(0.0).alias("score"))
            elif c in ("character", "chronotope"):
                if "presence" not in self.t:
                    warnings.append(f"{c}: no entities")
                    continue
                kinds = ["person", "group"] if c == "character" else ["location", "institution"]
                p = self.t["presence"].join(self.t["entities"].where(F.col("entity_type").isin(kinds)).select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
                who = p.where(F.col("scene_id").isin(scene_ids)).select("entity_id").distinct()
                rows = p.join(who, "entity_id", "left_semi").groupBy(F.col("scene_id").alias("id")).agg(F.countDistinct("entity_id").cast("double").alias("score"))
            else:
                if "scene_links" not in self.t:
                    warnings.append(f"{c}: no links")
                    continue
                l = search.both_ways(self.t["scene_links"].where(F.col("type") == _BY_TYPE[c]).select("source_id", "target_id", "reason"), "source_id", "target_id")
                rows = l.where(F.col("source_id").isin(scene_ids)).groupBy(F.col("target_id").alias("id")).agg(F.lit(0.0).alias("score"), F.min(F.concat(F.lit(f"{c}: "), F.coalesce("reason", F.lit("")))).alias("path"))
            best, cut = self._limited(rows.where(~F.col("id").isin(scene_ids)).join(place, "id"), r, limit)
            hits.append(self._hits(best, c, "scene"))
            more += [c] * cut
        if not hits:
            raise ValueError("; ".join(warnings))
        return self._result(hits, r, "", more, warnings)

    def related(self, result: Result, item_id: str, similar: int = 5) -> DataFrame:
        """Places related to one candidate: by links between events, by links between scenes, by similarity; see operators.related."""
        self.fresh(result)
        check(similar, 0, 20, "similar")
        one = result.candidates.where(F.col("id") == item_id).select(F.lit(self.book_id).alias("book_id"), F.lit(0).cast("long").alias("fragment"), "start_char", "end_char")
        if one.head(1) == []:
            raise ValueError("the candidate is not of this search")
        found, own = [], self._own("chunks")
        if {"events", "event_links"} <= self.t.keys():
            found.append(related.linked_events(one, self._own("events"), self.t["event_links"], own))
        if "scene_links" in self.t and "source_hash" in self.t["scene_links"].columns:
            found.append(related.linked_scenes(one, self._own("scenes"), self.t["scene_links"]))
        if similar and {"embedding", "embedding_model"} <= set(own.columns):
            found.append(related.similar_chunks(one, own, similar))
        if not found:
            raise ValueError("there are no links and no vectors")
        return related.related(*found).drop("fragment")

    def project(self, result: Result) -> Result:
        """Candidates of any origin as chunks, which inherit the best score of each channel."""
        self.fresh(result)
        items = result.candidates.select("search_id", F.lit(self.book_id).alias("book_id"), "start_char", "end_char", F.explode("scores").alias("channel", "score"))
        rows = search.project(items, self._own("chunks").select("book_id", F.col("start_char").cast("long"), F.col("end_char").cast("long")))
        pairs = rows.groupBy("search_id", "start_char", "end_char").agg(F.array_sort(F.collect_list(F.struct("channel", "score"))).alias("p"))
        made = pairs.select("search_id", "start_char", "end_char", F.concat_ws(":", "start_char", "end_char").alias("id"), F.map_from_entries("p").alias("scores"), F.aggregate("p", F.lit(0.0), lambda s, x: s + x["score"]).alias("score"))
        sid = uuid.uuid4().hex
        return Result(self._finish(made.withColumn("search_id", F.lit(sid))), sid, result.query, result.revision, result.truncated, result.warnings, [result.search_id], result.plan)

    def merge(self, results: list[Result], query: str = "") -> Result:
        """Searches of one revision as one."""
        check(len(results), 1, 20, "number of searches")
        for r in results:
            self.fresh(r)
        place = ["id", "start_char", "end_char"]
        every = None
        for n, r in enumerate(results):
            part = r.candidates.select(*place, F.lit(n).alias("search_no"), "scores", "review_status", "selected", "viewed")
            every = part if every is None else every.unionByName(part)
        merged = search.merge_searches(every).join(every.select(*place).distinct(), "id")
        sid = uuid.uuid4().hex
        made = merged.withColumns({"search_id": F.lit(sid), "score": F.aggregate(F.map_values("scores"), F.lit(0.0), lambda s, x: s + x), "scores": F.coalesce("scores", F.create_map().cast("map<string,double>"))})
        first = lambda lists: list(dict.fromkeys(x for xs in lists for x in xs))
        return Result(self._finish(made), sid, query, results[0].revision, first(r.truncated for r in results), first(r.warnings for r in results), [r.search_id for r in results])

    def page(self, result: Result, offset: int = 0, size: int = 10, status: str | None = None, excerpt: int = 1200) -> DataFrame:
        """A page of candidates with excerpts of the book's text and next_offset."""
        self.fresh(result)
        rows = search.page(result.candidates, offset, check(size, 1, 50, "page_size"), status)
        text = self._own("books").select(F.col("text").alias("__text"))
        return rows.join(F.broadcast(text)).withColumn("text", F.substring("__text", (F.col("start_char") + 1).cast("int"), F.least(F.lit(excerpt), F.col("end_char") - F.col("start_char")).cast("int"))).drop("__text")

    def context(self, start: int, end: int, around: int = 2000) -> str:
        """The book's text around a range, at most ``around`` characters more."""
        r = self._own("books").select(T.slice_of(F.col("text"), F.greatest(F.lit(0), F.lit(start - around // 2)), F.lit(end + around // 2)).alias("t")).first()
        return r.t

    def review(self, result: Result, verdicts: DataFrame) -> Result:
        """The search with verdicts(id, status, reason, evidence, seq) applied; quotes are found in the text."""
        text = self._own("books").select(F.col("text").alias("__text"))
        items = result.candidates.join(F.broadcast(text)).withColumn("text", T.slice_of(F.col("__text"), F.col("start_char"), F.col("end_char"))).select("id", "text", "start_char")
        judged = search.apply_verdicts(items, verdicts).select("id", F.col("review_status").alias("s"), F.col("reason").alias("r"), F.col("selected").alias("sel"), "verified", "quote_start", "quote_end", "quote")
        new = result.candidates.drop("verified", "quote_start", "quote_end", "quote").join(judged, "id").withColumns({"review_status": F.when(F.col("s") != "unreviewed", F.col("s")).otherwise(F.col("review_status")), "reason": F.when(F.col("s") != "unreviewed", F.col("r")).otherwise(F.col("reason")), "selected": F.when(F.col("s") != "unreviewed", F.col("sel")).otherwise(F.col("selected"))})
        return Result(_settled(new.drop("s", "r", "sel")), result.search_id, result.query, result.revision, result.truncated, result.warnings, result.parents, result.plan)

    def retrieve(self, words: list[str], descriptions: list[tuple[str, list[float]]] = (), entity_ids: list = (), criterion: str = "") -> Result:
        """A retrieval plan: each phrase in texts and scenes, each description by meaning, entities; merged and projected.

        A channel that fails becomes a warning; the plan stays with the search."""
        jobs = [(f"words {w!r} in {t}", lambda w=w, t=t: self.words(w, t, limit=5 if t == "scenes" else 200)) for w in words for t in ("text", "scenes", "context")]
        jobs += [(f"description {d!r}", lambda d=d, v=v: self.semantic(d, v, limit=15)) for d, v in descriptions]
        jobs += [("entities", lambda: self.scenes_for_entities(list(entity_ids)))] * bool(entity_ids)
        found, failed = [], []
        for name, job in jobs:
            try:
                found.append(job())
            except (ValueError, LookupError, KeyError) as e:
                failed.append(f"{name}: {e}")
        if not found:
            raise ValueError("; ".join(failed) or "nothing to search for")
        while len(found) > 1:
            found = [self.merge(found[i : i + 20], criterion) for i in range(0, len(found), 20)]
        out = self.project(found[0])
        out.warnings = [*out.warnings, *failed]
        out.plan = {"criterion": criterion, "words": list(words), "descriptions": [d for d, _ in descriptions], "entities": list(entity_ids)}
        return out


def render(answer: str, fragments: dict[str, str]) -> str:
    """An answer with its markers [[F1]] replaced by quoted fragments; an unknown marker says so."""

    def put(m: re.Match) -> str:
        quote = fragments.get(m[1])
        return "(фрагмент не подтверждён)" if quote is None else "\n> " + quote.replace("\n", "\n> ") + "\n"

    return re.sub(r"\[\[(F\d+)\]\]", put, answer)


def quotes_of(result: Result) -> DataFrame:
    """Selected items with their quotes, in order: (marker, id, quote)."""
    w = Window.partitionBy("search_id").orderBy("ord")
    return result.candidates.where("selected").select(F.concat(F.lit("F"), F.row_number().over(w).cast("string")).alias("marker"), "id", "quote")


__all__ = ["Result", "Search", "check", "check_query", "quotes_of", "render"]
