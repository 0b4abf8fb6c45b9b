"""All named queries with their oracles, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import spans
from lectern.operators import lexical, search
from lectern.plans import book_queries, cascade_queries, editing_queries, graph_queries, import_queries, judging_queries, resolution_queries, search_queries, text_queries, write_queries  # noqa: F401  they register their queries
from lectern.plans.registry import ORACLES, QUERIES, table

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    """A word search over chunks: BM25, rank fusion, clipping, ordering, first page with its texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = docs.select("doc_id", "text", F.explode(spans.chunks(F.col("text"))).alias("c"))
    chunks = cut.select("doc_id", F.concat_ws(":", "doc_id", "c.start_char").alias("chunk_id"), F.col("c.start_char").alias("start_char"), F.col("c.end_char").alias("end_char"), F.substring("text", F.col("c.start_char") + 1, F.col("c.end_char") - F.col("c.start_char")).alias("text"))
    scored = lexical.bm25(chunks, "chunk_id", ["the", "with"])
    best, _ = lexical.top(scored, "chunk_id", 10)
    hits = best.join(chunks, "chunk_id").withColumn("search_id", F.lit("s"))
    hits = search.ranked(hits, ["search_id"], F.desc("score"), "chunk_id").withColumn("channel", F.lit("words"))
    return hits.select("chunk_id", "start_char", "end_char", "channel", search.rrf(F.col("rank")).alias("score"), "text")
