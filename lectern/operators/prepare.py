"""Preparation of books: an ordered set of stages whose failures are recorded for each chapter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("scenes", "index", "mentions", "chapter_entities", "book_entities", "reconcile", "annotate", "links", "report")


@dataclass
class Plan:
    """Stages by name; each takes (tables, chapters) and returns (table or None, outcomes(chapter_id, ok, detail) or None)."""

    stages: dict[str, Callable[[dict[str, DataFrame], DataFrame], tuple[DataFrame | None, DataFrame | None]]] = field(default_factory=dict)
    continue_on_error: bool = True


def run(plan: Plan, tables: dict[str, DataFrame], chapters: DataFrame, cancelled: Callable[[], bool] = lambda: False) -> tuple[dict[str, DataFrame], list[tuple[str, str]], DataFrame]:
    """(tables, errors of whole stages, outcomes(stage, chapter_id, ok, detail)).

    A chapter that fails a stage takes no part in later ones; the others go on. A stage that fails as a
    whole is listed; with ``continue_on_error`` unset the first such error is raised after the stage."""
    tables, errors = dict(tables), []
    outcomes = chapters.select(F.lit("").alias("stage"), F.col("chapter_id").cast("string").alias("chapter_id"), F.lit(True).alias("ok"), F.lit("").alias("detail")).limit(0)
    left = chapters
    for name in STAGES:
        if name not in plan.stages:
            continue
        if cancelled():
            errors.append((name, "cancelled"))
            break
        try:
            table, found = plan.stages[name](tables, left)
        except Exception as e:  # noqa: BLE001  a stage's failure is a result
            errors.append((name, f"{type(e).__name__}: {e}"))
            if not plan.continue_on_error:
                raise
            continue
        if table is not None:
            tables[name] = table
        if found is not None:
            outcomes = outcomes.unionByName(found.select(F.lit(name).alias("stage"), F.col("chapter_id").cast("string").alias("chapter_id"), "ok", "detail"))
            left = left.join(found.where(~F.col("ok")).select("chapter_id"), "chapter_id", "left_anti")
    return tables, errors, outcomes


def status(chapters: DataFrame, scenes: DataFrame, mentions: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row for each chapter: scenes, ready ones, and how many have mentions and annotations of their present text."""
    s = scenes.select("chapter_id", "scene_id", "text_hash", "status")
    m = mentions.select("scene_id", "text_hash").distinct().withColumn("m", F.lit(1))
    a = annotations.where("status = 'ready'").select("scene_id", "text_hash").distinct().withColumn("a", F.lit(1))
    both = s.join(m, ["scene_id", "text_hash"], "left").join(a, ["scene_id", "text_hash"], "left")
    n = both.groupBy("chapter_id").agg(F.count("*").alias("scenes"), F.sum((F.col("status") == "ready").cast("long")).alias("ready"), F.sum(F.coalesce("m", F.lit(0))).cast("long").alias("extracted"), F.sum(F.coalesce("a", F.lit(0))).cast("long").alias("annotated"))
    return chapters.select("chapter_id").join(n, "chapter_id", "left").na.fill(0)


def coverage(scenes: DataFrame, covered: DataFrame) -> DataFrame:
    """(book_id, scenes, ready, covered) of scenes(book_id, id, ready) and covered(id); coverage is reduced to scenes before the join."""
    both = scenes.join(covered.select("id", F.lit(True).alias("c")).distinct(), "id", "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return both.groupBy("book_id").agg(F.count("*").alias("scenes"), n(F.col("ready")).alias("ready"), n(F.col("c")).alias("covered"))
