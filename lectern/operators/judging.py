"""Checking of candidates by an oracle, manual review, the selection of a conversation and its report, over many searches at once.

The oracle's replies are tables with an attempt each; a second attempt is asked only about what the first left open.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Verdicts and the states they give, states in order, channels that cost nothing or need entities or links.
VERDICTS = {"relevant": "relevant", "partial": "uncertain", "irrelevant": "rejected"}
STATES = ("relevant", "uncertain", "rejected", "unreviewed")
BASELINE, WITH_ENTITIES, WITH_LINKS = ("discourse",), ("character", "chronotope", "soft_character"), ("retelling", "prefiguring", "parallel", "causal")
#: Characters of a text for the model, of an evidence and of a reason; anchors of an expansion.
MODEL_TEXT, EVIDENCE, REASON, MANUAL, ANCHORS = 500, 300, 500, 2000, 10


@dataclass(frozen=True)
class Limits:
    """Bounds of one turn of the agent."""

    model_calls: int = 8
    tool_calls: int = 10
    observed_tokens: int = 30_000
    input_tokens: int = 48_000
    history_tokens: int = 8_000
    output_tokens: int = 4_000
    total_tokens: int = 250_000
    judge_calls: int = 40
    judge_tokens: int = 400_000
    candidate_limit: int = 150
    judge_limit: int = 120
    judge_batch: int = 10
    filter_limit: int = 80
    context_entities: int = 30


def effective_channels(asked: Column, entities_ready: Column, links_ready: Column) -> Column:
    """Sorted channels: those asked for, the cheap ones, and those whose data are ready."""
    some = lambda names, ready: F.when(ready, F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))
    every = F.concat(asked, F.array(*[F.lit(n) for n in BASELINE]), some(WITH_ENTITIES, entities_ready), some(WITH_LINKS, links_ready))
    return F.array_sort(F.array_distinct(every))


def anchors(candidates: DataFrame, status: str | None = None, most: int = ANCHORS) -> DataFrame:
    """The first candidates(search_id, id, ord, review_status) of each search, of one state or any: what an expansion starts from."""
    rows = candidates if status is None else candidates.where(F.col("review_status") == status)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("search_id").orderBy("ord"))).where(F.col("nth") <= most)


def batches(candidates: DataFrame, size: int = 10, most: int | None = None) -> DataFrame:
    """Unreviewed candidates(search_id, id, ord, review_status) in batches of ``size``: column ``batch`` from 0; ``most`` a search at most."""
    rows = candidates.where("review_status = 'unreviewed'").withColumn("__n", F.row_number().over(Window.partitionBy("search_id").orderBy("ord")) - 1)
    rows = rows if most is None else rows.where(F.col("__n") < most)
    return rows.withColumn("batch", F.floor(F.col("__n") / size).cast("int")).drop("__n")


def by_scene(candidates: DataFrame, context: DataFrame) -> DataFrame:
    """(search_id, batch, nth, scene_id, title, summary, candidates): a batch's candidates grouped by scene, scenes in the order of their first.

    candidates(search_id, batch, ord, id, text, section), context(search_id, id, scene_id, scene_title, scene_summary, previous_tail, next_head)."""
    both = candidates.join(context, ["search_id", "id"], "left")
    one = F.struct("ord", "id", F.coalesce("previous_tail", F.lit("")).alias("before"), "text", F.coalesce("next_head", F.lit("")).alias("after"), "section")
    found = both.groupBy("search_id", "batch", "scene_id").agg(F.first("scene_title", True).alias("title"), F.first("scene_summary", True).alias("summary"), F.array_sort(F.collect_list(one)).alias("candidates"), F.min("ord").alias("__first"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("search_id", "batch").orderBy("__first")) - 1).drop("__first")


def verdicts(candidates: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, report) from replies(search_id, id, attempt, seq, verdict, reason, evidence) about candidates(search_id, id).

    The first valid reply counts; one of a later attempt only about candidates that no earlier attempt decided. The report has the
    numbers of candidates, decided and undecided ones."""
    states = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])
    known = replies.withColumn("status", F.try_element_at(states, F.col("verdict"))).where("status is not null").join(candidates.select("search_id", "id"), ["search_id", "id"], "left_semi")
    first = known.withColumn("__n", F.row_number().over(Window.partitionBy("search_id", "id").orderBy("attempt", "seq"))).where("__n = 1")
    reason = F.nullif(F.substring(F.trim(F.coalesce("reason", F.lit(""))), 1, REASON), F.lit(""))
    good = first.select("search_id", "id", "status", F.coalesce(reason, F.lit("Без пояснения")).alias("reason"), F.substring(F.coalesce("evidence", F.lit("")), 1, EVIDENCE).alias("evidence"), "attempt")
    counted = candidates.select("search_id", "id").join(good.select("search_id", "id", "status"), ["search_id", "id"], "left").groupBy("search_id")
    report = counted.agg(F.count("*").alias("total"), F.count("status").alias("judged"), (F.count("*") - F.count("status")).alias("open"))
    return good, report


def pending(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Candidates that a further attempt must ask about."""
    return candidates.join(verdicts(candidates, replies)[0].select("search_id", "id"), ["search_id", "id"], "left_anti")


def judge(batch: list[dict], ask: Callable[[list[dict], int], list[dict] | None], attempts: int = 2) -> tuple[list[dict], bool]:
    """(verdicts, exhausted) of one batch: what a reply leaves out is asked once more; None means that the budget is spent."""
    found: dict[str, dict] = {}
    for attempt in range(attempts):
        left = [c for c in batch if c["id"] not in found]
        if not left:
            break
        reply = ask(left, attempt)
        if reply is None:
            return list(found.values()), True
        open_ids = {c["id"] for c in left}
        for row in reply:
            if row.get("id") in open_ids and row.get("verdict") in VERDICTS and row["id"] not in found:
                found[row["id"]] = row | {"status": VERDICTS[row["verdict"]]}
    return list(found.values()), False


def review(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, faults) after decisions(search_id, id, status, reason, at), one for each candidate, of a person.

    A decision needs a known state and a reason of 1 to 2000 characters. It is added to review_history(status, reason, at); what
    isn't relevant is no longer selected."""
    d = decisions.select("search_id", "id", F.col("status").alias("__s"), F.trim("reason").alias("__r"), F.length("reason").alias("__n"), F.col("at").alias("__at"))
    known = d.join(candidates.select("search_id", "id", F.lit(True).alias("__known")), ["search_id", "id"], "left")
    problem = F.when(~F.coalesce(F.col("__s").isin(*STATES), F.lit(False)), "status").when((F.coalesce("__r", F.lit("")) == "") | (F.col("__n") > MANUAL), "reason").when(F.col("__known").isNull(), "unknown candidate")
    judged = known.withColumn("problem", problem)
    both = candidates.join(judged.where("problem is null").drop("problem", "__known"), ["search_id", "id"], "left")
    entry = F.struct(F.col("__s").alias("status"), F.col("__r").alias("reason"), F.col("__at").alias("at"))
    kind = dict(candidates.dtypes)["review_history"]
    log = F.when(F.col("__s").isNull(), F.col("review_history")).otherwise(F.concat(F.coalesce(F.col("review_history"), F.array().cast(kind)), F.array(entry).cast(kind)))
    out = both.withColumns({"review_history": log, "review_status": F.coalesce("__s", "review_status"), "reason": F.coalesce("__r", "reason"), "selected": F.col("selected") & F.coalesce(F.col("__s") == "relevant", F.lit(True))})
    return out.select(*candidates.columns), judged.where("problem is not null").select("search_id", "id", "problem")


def manual_reason(previous: Column, mark: str = "решение исследователя") -> Column:
    """The reason of a manual decision, with what the model said before it; an earlier manual decision isn't nested."""
    said = F.trim(F.coalesce(previous, F.lit("")))
    inner = F.when(F.startswith(said, F.lit(mark)), F.regexp_replace(F.regexp_extract(said, r"(?s)было: (.*)$", 1), r"\)+$", "")).otherwise(said)
    return F.when(inner == "", F.lit(mark)).otherwise(F.concat(F.lit(f"{mark} (было: "), F.substring(inner, 1, 300), F.lit(")")))


def quotes(candidates: DataFrame) -> DataFrame:
    """candidates(text, start_char, selected_ranges) with ``quote``, ``quote_start`` and ``quote_end``: the first selected range, or the whole."""
    r = F.try_element_at("selected_ranges", F.lit(1))
    start = F.coalesce(r["start_char"], F.col("start_char"))
    end = F.coalesce(r["end_char"], F.col("start_char") + F.length("text"))
    return candidates.withColumns({"quote": F.substring("text", (start - F.col("start_char") + 1).cast("int"), (end - start).cast("int")), "quote_start": start, "quote_end": end})


def markers(shown: DataFrame) -> DataFrame:
    """shown(search_id, id, status, start_char, text, ...) with ``marker`` F1, F2 ... and ``model_text`` of at most 500 characters.

    Relevant ones come first, then by place; a text that is cut ends in an ellipsis."""
    order = Window.partitionBy("search_id").orderBy((F.col("status") != "relevant").cast("int"), "start_char", "id")
    short = F.when(F.length("text") > MODEL_TEXT, F.concat(F.substring("text", 1, MODEL_TEXT), F.lit("…"))).otherwise(F.col("text"))
    return shown.withColumns({"marker": F.concat(F.lit("F"), F.row_number().over(order).cast("string")), "model_text": short})


def report_line(action: Column, judged: Column, total: Column, counts: dict[str, Column]) -> Column:
    """One line on a check: how many were judged, and how many of each state the selection has by now."""
    text = F.concat(action, F.lit(": проверено "), judged, F.lit(" из "), total, F.lit(" кандидатов, в выборке подходят "), counts["relevant"], F.lit(", под вопросом "), counts["uncertain"], F.lit(", отклонено "), counts["rejected"])
    more = F.when(counts["unreviewed"] > 0, F.concat(F.lit(", не проверено "), counts["unreviewed"], F.lit(" (можно попросить «найди ещё»)"))).otherwise(F.lit(""))
    return F.concat(text, more, F.lit("."))


def turn(messages: DataFrame, conversations: DataFrame, asked: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) after a turn: asked(conversation_id, text) and answers(conversation_id, text) at the next positions.

    A conversation that isn't there yet is made, titled by the first 60 characters of its question; one without an answer gets the question alone."""
    new = asked.join(conversations.select("conversation_id"), "conversation_id", "left_anti").select("conversation_id", F.substring(F.trim("text"), 1, 60).alias("title"))
    top = messages.groupBy("conversation_id").agg(F.max("position").alias("top"))
    lines = asked.select("conversation_id", F.lit(1).alias("k"), F.lit("user").alias("role"), "text").unionByName(answers.join(asked.select("conversation_id"), "conversation_id", "left_semi").select("conversation_id", F.lit(2).alias("k"), F.lit("assistant").alias("role"), "text"))
    placed = lines.join(top, "conversation_id", "left").select("conversation_id", (F.coalesce("top", F.lit(0)) + F.col("k")).cast(dict(messages.dtypes)["position"]).alias("position"), "role", "text")
    return conversations.unionByName(new, allowMissingColumns=True), messages.unionByName(placed, allowMissingColumns=True)


def preview(result: object, limit: int, count: Callable[[str], int]) -> tuple[str, bool]:
    """(JSON, cut): a result whole if it has at most ``limit`` tokens, else wrapped with the longest prefix that fits, else nothing."""
    dump = lambda x: json.dumps(x, ensure_ascii=False)
    whole = dump(result)
    if count(whole) <= limit:
        return whole, False
    wrapped = lambda n: dump({"output_truncated": True, "preview": whole[:n]})
    if count(wrapped(0)) > limit:
        return "", True
    low, high = 0, len(whole)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if count(wrapped(middle)) <= limit else (low, middle - 1)
    return wrapped(low), True


def agent_context(outline: DataFrame, status: DataFrame, entities: DataFrame, counts: DataFrame, most: int = Limits.context_entities) -> DataFrame:
    """(book_id, outline, index, entities, selection) for the agent: sections in order, what is ready, the commonest entities, counts by state.

    outline(book_id, id, title, role, level, start), status(book_id, ready, semantic, entities), entities(book_id, canonical_name,
    aliases, entity_type, scene_count), counts(book_id, review_status, n). A book without entities ready has none listed."""
    o = outline.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "level", "id", F.coalesce("title", "role").alias("title")))), lambda x: F.struct(x["id"], x["title"], x["level"])).alias("outline"))
    w = Window.partitionBy("book_id").orderBy(F.desc("scene_count"), "canonical_name")
    top = entities.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    e = top.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "canonical_name", F.slice("aliases", 1, 4).alias("aliases"), "entity_type"))), lambda x: F.struct(x["canonical_name"], x["aliases"], x["entity_type"])).alias("entities"))
    c = counts.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("review_status", "n")))).alias("selection"))
    both = status.join(o, "book_id", "left").join(e.withColumnRenamed("entities", "named"), "book_id", "left").join(c, "book_id", "left")
    return both.select("book_id", "outline", F.struct("ready", "semantic", "entities").alias("index"), F.when(F.col("entities"), F.col("named")).alias("entities"), "selection")
