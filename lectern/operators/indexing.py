"""What an index embeds: chunks with their contexts, titles and summaries of scenes; vectors are kept by the hash of their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import vectors as V
from lectern.operators import writes


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def chunk_inputs(t: writes.Tables, books: DataFrame) -> DataFrame:
    """Chunks of the books(book_id) with ``input`` and ``embedding_hash``: the annotation's context, a blank line and the text, or the text alone.

    Stored vectors are taken off; the cache has them. Only keys meet the books, and texts meet the keys, so that no task has all texts of a book."""
    own = t["chunks"].drop("embedding", "embedding_hash", "embedding_model", "input")
    keys = writes.only(own.select("book_id", "id").distinct(), books, {"book_id": "book_id"})
    context = F.col("context") if "context" in own.columns else F.lit(None).cast("string")
    if "annotations" in t and "context" in t["annotations"].columns:
        own = own.drop("context")
        noted = t["annotations"].select("book_id", F.col("chunk_id").alias("id"), "context").dropDuplicates(["book_id", "id"])
        keys, context = keys.join(noted, ["book_id", "id"], "left"), F.col("context")
    columns = own.columns + ["context"] * ("context" in keys.columns)
    keys = keys.withColumnsRenamed({"book_id": "__book", "id": "__id"})
    own = own.join(keys, (F.col("book_id") == F.col("__book")) & F.col("id").eqNullSafe(F.col("__id"))).select(*columns)
    own = own.withColumn("input", F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text")))
    return own.withColumn("embedding_hash", _hash(F.col("input")))


def scene_inputs(t: writes.Tables, books: DataFrame) -> DataFrame:
    """(book_id, chapter_id, id, input, embedding_hash) of scenes of searchable layers with a title or summary that isn't stale."""
    s = writes.only(t["scenes"], books, {"book_id": "book_id"})
    parts = [F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "summary") if c in s.columns]
    if not parts:
        return s.limit(0).select("book_id", "chapter_id", "id", F.lit("").alias("input"), F.lit("").alias("embedding_hash"))
    if "layers" in t:
        s = writes.only(s, t["layers"].where(F.col("status").isin(*writes.SEARCHABLE)), {"book_id": "book_id", "chapter_id": "chapter_id"})
    if "description_stale" in s.columns:
        s = s.where(~F.coalesce("description_stale", F.lit(False)))
    text = F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")
    return s.select("book_id", "chapter_id", "id", text.alias("input")).where("input <> ''").withColumn("embedding_hash", _hash(F.col("input")))


def cached(t: writes.Tables, books: DataFrame) -> DataFrame:
    """(hash, model, embedding) of the vectors that chunks and summaries of the books have, one for each hash and model."""
    found = None
    for name in ("chunks", "summary_embeddings"):
        if name in t and {"embedding", "embedding_hash", "embedding_model"} <= set(t[name].columns):
            own = writes.only(t[name], books, {"book_id": "book_id"}).where("embedding is not null and embedding_hash is not null")
            part = own.select(F.col("embedding_hash").alias("hash"), F.col("embedding_model").alias("model"), F.col("embedding").cast("array<double>").alias("embedding"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return t["books"].sparkSession.createDataFrame([], "hash string, model string, embedding array<double>")
    return found.groupBy("hash", "model").agg(F.min("embedding").alias("embedding"))


def misses(chunks: DataFrame, scenes: DataFrame, cache: DataFrame, model: str, chapters: DataFrame | None = None) -> DataFrame:
    """Distinct (hash, text) of the inputs that the cache has no vector of the model for; of the chapters(book_id, chapter_id) only, if given."""
    rows = chunks.select("book_id", "chapter_id", "embedding_hash", "input").unionByName(scenes.select("book_id", "chapter_id", "embedding_hash", "input"))
    if chapters is not None:
        rows = writes.only(rows, chapters, {"book_id": "book_id", "chapter_id": "chapter_id"})
    wanted = rows.groupBy(F.col("embedding_hash").alias("hash")).agg(F.min("input").alias("text"))
    return wanted.join(cache.where(F.col("model") == model), "hash", "left_anti").select("hash", "text")


def vectors(fresh: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(hash, embedding) of the model, new and cached ones; ValueError unless all are finite, not zero and of one dimension."""
    every = fresh.select("hash", "embedding").where("embedding is not null").unionByName(cache.where(F.col("model") == model).select("hash", "embedding")).groupBy("hash").agg(F.min("embedding").alias("embedding"))
    size = every.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.sum((~V.valid(F.col("embedding"))).cast("int")).alias("bad")).first()
    if size.low is not None and (size.low != size.high or size.low == 0 or size.bad):
        raise ValueError("embeddings must be finite, not zero and of one dimension")
    return every


def with_vectors(rows: DataFrame, found: DataFrame, model: str) -> DataFrame:
    """rows(embedding_hash, ...) with embedding and embedding_model, null where there is no vector; ``input`` is dropped."""
    named = found.select(F.col("hash").alias("embedding_hash"), "embedding")
    return rows.drop("input").join(named, "embedding_hash", "left").withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), F.lit(model)))
