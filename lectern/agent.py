"""Tools of a research agent over one book: searches, expansion, checking by a judge, the selection, reading.

The language model stays outside: it calls these tools, and ``judge`` answers about batches of candidates. Limits bound what
one turn may do. Every tool returns plain values, since a model reads them; pages are small by construction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import editing, judging
from lectern.service import Result, Search, _settled

_REVIEW = "search_id string, id string, status string, reason string, at string"
_VERDICTS = "id string, status string, reason string, evidence string, seq int"


class Exhausted(RuntimeError):
    """A limit of the turn is reached."""


class Tools:
    """The nine tools of one turn."""

    def __init__(self, search: Search, judge: Callable[[str, list[dict], int], list[dict] | None], limits: judging.Limits = judging.Limits()):
        self.search, self.judge, self.limits = search, judge, limits
        self.selection: Result | None = None
        self.notes: list[str] = []
        self.calls = self.judge_calls = 0

    def _begin(self) -> None:
        self.calls += 1
        if self.calls > self.limits.tool_calls:
            raise Exhausted("no tool calls are left in this turn")

    def _current(self) -> Result:
        if self.selection is None:
            raise ValueError("there is no selection yet; begin with search_fragments")
        return self.selection

    def _texts(self, rows: DataFrame) -> list[dict]:
        text = self.search._own("books").select(F.col("text").alias("__text"))  # one row
        cut = F.substring("__text", (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
        return [r.asDict() for r in rows.join(F.broadcast(text)).select("id", "start_char", "end_char", "review_status", "reason", "ord", cut.alias("text")).orderBy("ord").collect()]

    def _check(self, action: str, criterion: str, items: list[dict]) -> dict:
        """Ask the judge about items in batches and take its verdicts into the selection."""
        found, spent = [], False
        for a in range(0, len(items), self.limits.judge_batch):
            if self.judge_calls >= self.limits.judge_calls:
                spent = True
                break
            self.judge_calls += 1
            got, over = judging.judge(items[a : a + self.limits.judge_batch], lambda batch, n: self.judge(criterion, batch, n))
            found += got
            if over:
                spent = True
                break
        current = self._current()
        if found:
            v = self.search.spark.createDataFrame([(r["id"], r["status"], str(r.get("reason") or "")[: judging.REASON], str(r.get("evidence") or "")[: judging.EVIDENCE], n) for n, r in enumerate(found)], _VERDICTS)
            self.selection = self.search.review(current, v)
        counts = self.counts()
        self.notes.append(f"{action}: {len(found)} of {len(items)} checked")
        return {"criterion": criterion, "checked_now": len(found), "counts": counts, "budget_exhausted": spent, "rejected_reasons": [r.get("reason", "") for r in found if r["status"] == "rejected"][:5]}

    def counts(self) -> dict[str, int]:
        """How many candidates of the selection have each state."""
        got = {r.review_status: r["count"] for r in self._current().candidates.groupBy("review_status").count().collect()}  # four states
        return {s: got.get(s, 0) for s in judging.STATES}

    def search_fragments(self, criterion: str, words: list[str], descriptions: list[tuple[str, list[float]]] = (), entity_ids: list = ()) -> dict:
        """Search by words, meaning and entities, and check the first candidates against the criterion."""
        self._begin()
        self.selection = self.search.retrieve(words, descriptions, entity_ids, criterion)
        return self._check("search", criterion, self._texts(judging.batches(self.selection.candidates, self.limits.judge_batch, self.limits.judge_limit)))

    def expand_selection(self, channels: list[str], status: str = "relevant") -> dict:
        """Look around the first candidates of a state, add what is found to the selection and check it."""
        self._begin()
        current = self._current()
        first = judging.anchors(current.candidates, status)
        scenes = [s for r in first.select("scene_ids").collect() for s in (r.scene_ids or [])]  # at most judging.ANCHORS rows
        if not scenes:
            raise ValueError("no candidate of that state lies in a scene")
        more = self.search.project(self.search.expand(scenes, channels))
        plan = current.plan
        self.selection = replace(self.search.merge([current, more], current.query), plan=plan)
        return self._check("expansion", (plan or {}).get("criterion", ""), self._texts(judging.batches(self.selection.candidates, self.limits.judge_batch, self.limits.judge_limit)))

    def related_fragments(self, candidate_id: str, similar: int = 5) -> list[dict]:
        """Places related to a candidate, with how each was found."""
        self._begin()
        return [r.asDict() for r in self.search.related(self._current(), candidate_id, similar).orderBy("nth").limit(50).collect()]

    def filter_selection(self, criterion: str, status: str = "relevant") -> dict:
        """Check the candidates of a state again, against a narrower criterion."""
        self._begin()
        rows = self._current().candidates.where(F.col("review_status") == status).orderBy("ord").limit(self.limits.filter_limit)
        return self._check("filter", criterion, self._texts(rows))

    def set_fragment_status(self, candidate_id: str, status: str, reason: str, at: str = "") -> dict:
        """A decision of the person who asks."""
        self._begin()
        current = self._current()
        kind = dict(current.candidates.dtypes)
        rows = current.candidates
        if "review_history" not in kind:
            rows = rows.withColumn("review_history", F.array().cast("array<struct<status:string,reason:string,at:string>>"))
        d = self.search.spark.createDataFrame([(current.search_id, candidate_id, status, reason, at)], _REVIEW)
        changed, faults = judging.review(rows, d)
        wrong = faults.first()
        if wrong is not None:
            raise ValueError(wrong.problem)
        self.selection = replace(current, candidates=_settled(changed))
        return {"id": candidate_id, "status": status, "counts": self.counts()}

    def show_selection(self, status: str | None = None, offset: int = 0, size: int = 10) -> list[dict]:
        """A page of the selection with markers and short texts."""
        self._begin()
        page = self.search.page(self._current(), offset, size, status, excerpt=judging.MODEL_TEXT)
        shown = judging.markers(page.withColumnRenamed("review_status", "status"))
        return [r.asDict() for r in shown.select("marker", "id", "status", "model_text", "reason").collect()]

    def read_around(self, candidate_id: str, around: int = 2000) -> str:
        """The text around a candidate."""
        self._begin()
        r = self._current().candidates.where(F.col("id") == candidate_id).select("start_char", "end_char").first()
        if r is None:
            raise ValueError("the candidate is not of this search")
        return self.search.context(r.start_char, r.end_char, around)

    def read_section(self, section_id: str, start: int | None = None, limit: int = 4000) -> dict:
        """A section's text from a place on, and where to go on."""
        self._begin()
        s = self.search._own("sections").where(F.col("id") == section_id).select("book_id", "start_char", "end_char").first()
        if s is None:
            raise ValueError("unknown section")
        at = max(s.start_char, s.start_char if start is None else start)
        ranges = self.search.spark.createDataFrame([(s.book_id, at, s.end_char)], "book_id string, start_char int, end_char int")
        r = editing.read_text(self.search._own("books"), ranges, limit).first()
        return {"text": r.text, "next_start": r.next_start}

    def get_scenes(self, section_id: str, limit: int = 50) -> list[dict]:
        """Scenes that begin in a section, in reading order."""
        self._begin()
        s = self.search._own("sections").where(F.col("id") == section_id).select("start_char", "end_char").first()
        if s is None:
            raise ValueError("unknown section")
        rows = self.search._scenes().where(F.col("start_char").between(s.start_char, s.end_char - 1)).orderBy("start_char", "id").limit(limit)
        return [r.asDict() for r in rows.select("id", "title", "summary", "start_char", "end_char").collect()]
