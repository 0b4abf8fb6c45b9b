"""Export of reviewed items as CSV, Markdown and JSON rows, and how items were found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of statuses and of channels.
STATUS = {"relevant": "Подходит", "uncertain": "Под вопросом", "rejected": "Не подходит", "unreviewed": "Не проверено"}
CHANNELS = {"words": "по словам", "semantic": "по смыслу", "summaries": "по описанию сцены", "entity": "по персонажу", "neighbors": "соседняя сцена", "graph": "по порядку сцен"}


def _label(values: dict[str, str], c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), c), c)


def exportable(items: DataFrame, include_all: bool = False) -> DataFrame:
    """Relevant and selected items, or all."""
    return items if include_all else items.where((F.col("review_status") == "relevant") | F.col("selected"))


def how_found(path: Column, scores: Column) -> Column:
    """The path, if there is one, then the labels of the three best channels."""
    best = F.slice(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("c")))), 1, 3)
    names = F.transform(best, lambda x: _label(CHANNELS, F.split(x["c"], ":")[0]))
    return F.concat_ws("; ", path, F.array_join(F.array_distinct(names), "; "))


def quote(text: Column, start: Column, ranges: Column) -> Column:
    """The first selected range of an item's text, else all of it."""
    r = F.try_element_at(ranges, F.lit(1))
    part = F.substring(text, (r["start_char"] - start + 1).cast("int"), (r["end_char"] - r["start_char"]).cast("int"))
    return F.when(r.isNotNull(), part).otherwise(text)


def rows(items: DataFrame, include_all: bool = False) -> DataFrame:
    """Numbered export rows of items(search_id, ord, id, text, start_char, end_char, review_status, reason, selected, selected_ranges, sections, path, scores, query)."""
    kept = exportable(items, include_all)
    n = F.row_number().over(Window.partitionBy("search_id").orderBy("ord"))
    titles = F.array_join(F.transform("sections", lambda s: F.coalesce(s["title"], s["role"])), " / ")
    return kept.select(
        "search_id", n.alias("n"), _label(STATUS, F.col("review_status")).alias("status"), titles.alias("section"), quote(F.col("text"), F.col("start_char"), F.col("selected_ranges")).alias("quote"),
        F.col("text").alias("passage"), F.coalesce("reason", F.lit("")).alias("reason"), how_found(F.col("path"), F.col("scores")).alias("how"), "start_char", "end_char", "id", "query",
    )


def write_csv(export_rows: DataFrame, path: str) -> None:
    """CSV files with headers, quoted; each file begins with a byte-order mark in its first header."""
    first = export_rows.columns[0]
    export_rows.withColumnRenamed(first, f"﻿{first}").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def markdown(export_rows: DataFrame) -> DataFrame:
    """(search_id, n, markdown): one section of a report for each row."""
    head = F.concat(F.lit("## "), F.when(F.col("section") == "", "Без раздела").otherwise(F.col("section")), F.lit(" · символы "), F.col("start_char").cast("string"), F.lit("–"), F.col("end_char").cast("string"), F.lit(" · "), F.col("status"))
    why = F.when(F.col("reason") != "", F.concat(F.lit("*"), "reason", F.lit("*")))
    return export_rows.select("search_id", "n", F.concat_ws("\n", head, why, F.lit(""), F.concat(F.lit("> "), F.replace(F.col("quote"), F.lit("\n"), F.lit("\n> "))), F.lit("")).alias("markdown"))


def json(export_rows: DataFrame) -> DataFrame:
    """(search_id, n, json) of each row."""
    return export_rows.select("search_id", "n", F.to_json(F.struct(*[c for c in export_rows.columns if c not in ("search_id", "n")])).alias("json"))
