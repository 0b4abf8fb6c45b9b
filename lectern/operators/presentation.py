"""What people read about progress, states and faults, as columns; configuration of stages and usage."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of stages, of entity types and of faults, and the mark of an answer's footer.
STAGES = {
    "embeddings_check": "Проверка провайдера эмбеддингов", "scenes": "Сцены", "chunks": "Фрагменты текста", "embeddings": "Эмбеддинги", "mentions": "Упоминания персонажей и мест",
    "chapter_entities": "Персонажи и места глав", "book_entities": "Персонажи и места книги", "reconciliation": "Проверка повторов", "narrative": "Нарративная разметка", "narrative_links": "Связи между сценами и событиями",
}
ROW_OF_STAGE = {"embeddings_check": "embeddings", "reconciliation": "book_entities"}
TYPES = {"person": "персонаж", "location": "место", "organization": "организация", "group": "группа", "institution": "учреждение", "vehicle": "предмет", "artifact": "предмет", "object": "предмет", "other": "другое"}
FAULTS = {"data_inspection_failed": "провайдер модели отклонил текст своим фильтром содержания", "connection": "нет соединения с провайдером модели", "rate_limit": "превышен лимит запросов к провайдеру модели"}
FOOTER = "\n---\n*Как искала.*"


def _label(key: Column, labels: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), key), default)


def type_label(kind: Column) -> Column:
    return _label(kind, TYPES, F.lit("тип не определён"))


def progress(key: Column, position: Column, total: Column, title: Column) -> Column:
    """``stage: 2 из 5 · chapter``; without a step and a title the stage and an ellipsis."""
    step = F.when(total > 1, F.concat(position, F.lit(" из "), total))
    parts = F.filter(F.array(step, F.nullif(title, F.lit(""))), lambda x: x.isNotNull())
    label = _label(key, STAGES, key)
    return F.when(F.size(parts) > 0, F.concat(label, F.lit(": "), F.array_join(parts, " · "))).otherwise(F.concat(label, F.lit("…")))


def fault(code: Column, name: Column) -> Column:
    """What a provider's error means."""
    return _label(code, FAULTS, F.concat(F.lit("ошибка провайдера модели ("), name, F.lit(")")))


def cause(text: Column, cause_name: Column, cause_text: Column) -> Column:
    """A message with its cause, unless it tells it already."""
    told = cause_text.isNull() | (cause_text == "") | F.contains(text, cause_text)
    return F.when(F.coalesce(told, F.lit(True)), text).otherwise(F.concat(text, F.lit(" ("), cause_name, F.lit(": "), cause_text, F.lit(")")))


def preparation_fault(key: Column, chapter: Column, scene: Column, detail: Column) -> Column:
    """``stage (chapter, scene 2 из 5): detail`` from a stage's key, the title of a chapter and a scene as ``2/5``."""
    of = F.concat(F.lit("сцена "), F.substring_index(scene, "/", 1), F.lit(" из "), F.substring_index(scene, "/", -1))
    where = F.filter(F.array(F.concat(F.lit("глава «"), chapter, F.lit("»")), of), lambda x: x.isNotNull())
    return F.concat(_label(key, STAGES, key), F.when(F.size(where) > 0, F.concat(F.lit(" ("), F.array_join(where, ", "), F.lit(")"))).otherwise(F.lit("")), F.lit(": "), detail)


def split_answer(content: Column) -> tuple[Column, Column]:
    """(answer, footer) of a stored message; without the footer's mark all is answer."""
    at = F.instr(content, F.lit(FOOTER))
    body, rest = F.substring(content, F.lit(1), at - 1), F.substring(content, at + len(FOOTER), F.length(content))
    return F.when(at > 0, F.regexp_replace(body, r"\s+$", "")).otherwise(content), F.when(at > 0, F.trim(F.regexp_replace(rest, r"^\s+|\s+$", ""))).otherwise(F.lit(""))


def checklist(status: DataFrame, embeddings: bool = True, narrative: bool = True) -> DataFrame:
    """(book_id, nth, key, label, count, state) from the counters of status, one row a book; ``done`` when nothing is left.

    status(book_id, chapters, scene_chapters, scenes, chunks, embedded_chunks, extracted_scenes, chapter_entity_chapters,
    book_entities, presence_edges, narrative_scenes, annotated_scenes, scene_links, narrative_links)."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    of = lambda a, b, unit: F.concat(c(a), F.lit("/"), c(b), F.lit(unit))
    full = (c("chapters") > 0) & (c("scene_chapters") == c("chapters"))
    told = (c("narrative_scenes") > 0) & (c("annotated_scenes") == c("narrative_scenes"))
    rows = [("scenes", of("scene_chapters", "chapters", " глав"), full), ("chunks", c("chunks").cast("string"), full & (c("chunks") > 0))]
    if embeddings:
        rows.append(("embeddings", of("embedded_chunks", "chunks", ""), (c("chunks") > 0) & (c("embedded_chunks") == c("chunks"))))
    rows += [
        ("mentions", of("extracted_scenes", "scenes", " сцен"), (c("scenes") > 0) & (c("extracted_scenes") == c("scenes"))),
        ("chapter_entities", of("chapter_entity_chapters", "chapters", " глав"), (c("chapters") > 0) & (c("chapter_entity_chapters") == c("chapters"))),
        ("book_entities", F.concat(c("book_entities"), F.lit(" · связей со сценами "), c("presence_edges")), c("book_entities") > 0),
    ]
    if narrative:
        rows += [("narrative", of("annotated_scenes", "narrative_scenes", " сцен"), told), ("narrative_links", F.concat(F.lit("сцен "), c("scene_links"), F.lit(" · событий "), c("narrative_links")), told)]
    made = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(k).alias("key"), F.lit(STAGES[k]).alias("label"), n.alias("count"), F.when(d, "done").otherwise("todo").alias("state")) for i, (k, n, d) in enumerate(rows)])
    return status.select("book_id", F.inline(made))


def chapter_table(chapters: DataFrame, failures: DataFrame, embeddings: bool = True) -> DataFrame:
    """(book_id, chapter_id, scenes_state, chunks_state, mentions_state, chapter_entities_state, error) of chapters with their counters.

    chapters(book_id, chapter_id, scene_status, scenes, chunks, embedded_chunks, extracted_scenes, chapter_entity_status),
    failures(book_id, chapter_id, key, message): a failure marks its cell and is never hidden by a counter."""
    scenes = F.coalesce(F.col("scene_status") == "ready", F.lit(False))
    chunks = scenes & (F.col("chunks") > 0) & ((F.col("embedded_chunks") == F.col("chunks")) if embeddings else F.lit(True))
    mentions = (F.col("scenes") > 0) & (F.col("extracted_scenes") == F.col("scenes"))
    entities = F.coalesce(F.col("chapter_entity_status") == "ready", F.lit(False))
    state = lambda key, done: F.when(F.col("key") == key, "error").when(F.coalesce(done, F.lit(False)), "done").otherwise("todo").alias(f"{key}_state")
    both = chapters.join(failures.select("book_id", "chapter_id", "key", "message"), ["book_id", "chapter_id"], "left")
    return both.select("book_id", "chapter_id", state("scenes", scenes), state("chunks", chunks), state("mentions", mentions), state("chapter_entities", entities), F.coalesce("message", F.lit("")).alias("error"))


def used_tokens(actual: Column, reserved: Column) -> Column:
    """What a request cost: what the provider says, else what was set aside."""
    return F.coalesce(actual, reserved)


@dataclass(frozen=True)
class Stage:
    """Bounds and model of one stage of preparation."""

    model: str = ""
    effort: str | None = None
    max_calls: int = 64
    max_total_tokens: int = 2_500_000
    max_output_tokens: int = 6_000


def stage(base: Stage, overrides: dict[str, dict], name: str) -> Stage:
    """The configuration of a stage: the common one with the stage's own values; unknown names are refused."""
    return replace(base, **overrides.get(name, {}))
