"""The life of an uploaded book: upload, import, a new parse, stored elements; by tables, many files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.sessions import Conflict
from lectern.sources.books import LIMIT

#: States of an upload, in order.
STATES = ("saved", "processing", "ready", "error")
SUFFIXES = (".epub", ".md", ".markdown")


def list_hash(texts: Column) -> Column:
    """SHA-256 of an array of texts as a JSON list, which is what a book's text is identified by."""
    quoted = F.transform(texts, lambda t: F.regexp_extract(F.to_json(F.array(t)), r"(?s)^\[(.*)\]$", 1))
    return F.sha2(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")), 256)


def uploads(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(book_id, path, n_bytes, status, error) of files(path, content): one row for each distinct content, by its first path.

    Files above the limit or of another kind are errors and need not be parsed."""
    rows = files.select(F.sha2("content", 256).alias("book_id"), "path", F.octet_length("content").alias("n_bytes"))
    one = rows.groupBy("book_id").agg(F.min("path").alias("path"), F.max("n_bytes").alias("n_bytes"))
    kind = F.regexp_extract(F.lower("path"), r"(\.[^./]*)$", 1)
    error = F.when(F.col("n_bytes") > limit, "too large").when(~kind.isin(*SUFFIXES), "kind")
    return one.select("book_id", "path", "n_bytes", F.when(error.isNull(), "saved").otherwise("error").alias("status"), error.alias("error"))


def advanced(saved: DataFrame, parsed: DataFrame) -> DataFrame:
    """uploads after an import: ready or an error where parsed(book_id, error) says so, processing where a parse is missing."""
    p = parsed.select("book_id", F.col("error").alias("__e"), F.lit(True).alias("__p")).dropDuplicates(["book_id"])
    both = saved.join(p, "book_id", "left")
    todo = F.col("status").isin("saved", "processing")
    status = F.when(~todo, F.col("status")).when(F.col("__p").isNull(), "processing").when(F.col("__e").isNull(), "ready").otherwise("error")
    return both.select("book_id", "path", "n_bytes", status.alias("status"), F.when(todo, F.col("__e")).otherwise(F.col("error")).alias("error"))


def reparsed(known: DataFrame, parsed: DataFrame, version: int) -> DataFrame:
    """(book_id, action) of known books(book_id, text_hash, parser_version) after a newer parser read them.

    upgrade: the texts are the same, so only structure may change; changed: the texts differ and the stored book stays; current:
    this version read it already; missing: there is no readable parse."""
    p = parsed.where("error is null").select("book_id", F.col("text_hash").alias("now")).dropDuplicates(["book_id"])
    action = F.when(F.col("parser_version") >= version, "current").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("text_hash"), "upgrade").otherwise("changed")
    return known.join(p, "book_id", "left").select("book_id", action.alias("action"))


def legacy(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, damaged) of saved snapshots(book_id, elements array<string>, elements_hash): those whose elements have their hash."""
    judged = snapshots.withColumn("__ok", F.coalesce(list_hash(F.col("elements")) == F.col("elements_hash"), F.lit(False)))
    return judged.where("__ok").drop("__ok"), judged.where("not __ok").select("book_id")


def write_once(spark: SparkSession, path: str, rows: DataFrame) -> bool:
    """Store rows at ``path`` unless they are there; Conflict if others are. Tells whether it wrote."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        old = spark.read.parquet(path)
        if old.columns != rows.columns or old.exceptAll(rows).head(1) or rows.exceptAll(old).head(1):
            raise Conflict(f"other rows are stored at {path}")
        return False
    rows.write.parquet(path)
    return True


def restored(current: DataFrame, original: DataFrame, books: DataFrame, approved: DataFrame) -> DataFrame:
    """Sections with those of the books(book_id) put back to the original; only approved(book_id) structures may be exported."""
    return current.join(books.select("book_id"), "book_id", "left_anti").unionByName(original.join(books.select("book_id"), "book_id", "left_semi")).join(approved.select("book_id"), "book_id", "left_semi")


def exported(sections: DataFrame, approved: DataFrame) -> DataFrame:
    """(book_id, structure): sections of approved books as JSON, in order."""
    rows = sections.join(approved.select("book_id"), "book_id", "left_semi")
    order = [c for c in ("start", "level", "id") if c in sections.columns]
    rest = [c for c in sections.columns if c not in ("book_id", *order)]
    return rows.groupBy("book_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *rest)))).alias("structure"))
