"""Queries over uploads and imports: pages and documents as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.registry import query, table
from lectern.sources import imports


def files(spark, sf_dir):
    """Pages as files of three kinds, every one twice."""
    kind = F.element_at(F.array(F.lit(".epub"), F.lit(".md"), F.lit(".txt")), (F.col("page_id") % 3 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), kind.alias("kind"), F.concat(F.col("page_id").cast("string"), F.lit(":"), F.coalesce("html", F.lit(""))).cast("binary").alias("content"))
    return p.select(F.concat(F.lit("b/"), "id", "kind").alias("path"), "content").union(p.select(F.concat(F.lit("a/"), "id", "kind").alias("path"), "content"))


_FILES = "f AS (SELECT page_id, page_id || ':' || coalesce(html, '') AS c, 'a/' || page_id || (['.epub', '.md', '.txt'])[page_id % 3 + 1] AS path FROM pages)"


@query(f"WITH {_FILES} SELECT sha256(c) AS book_id, path, CAST(octet_length(encode(c)) AS INTEGER) AS n_bytes, CASE WHEN octet_length(encode(c)) > 2000 OR page_id % 3 = 2 THEN 'error' ELSE 'saved' END AS status, CASE WHEN octet_length(encode(c)) > 2000 THEN 'too large' WHEN page_id % 3 = 2 THEN 'kind' END AS error FROM f")
def q_uploads(spark, sf_dir):
    """Uploads of at most 2000 bytes and two kinds; of equal files one row."""
    return imports.uploads(files(spark, sf_dir), 2000)


@query(f"""WITH {_FILES}, u AS (SELECT page_id, sha256(c) AS book_id, CASE WHEN page_id % 3 = 2 THEN 'error' ELSE 'saved' END AS status FROM f)
SELECT book_id, CASE WHEN status = 'error' THEN 'error' WHEN page_id % 5 = 0 THEN 'processing' WHEN page_id % 5 = 1 THEN 'error' ELSE 'ready' END AS status FROM u""")
def q_import_status(spark, sf_dir):
    """Uploads after an import that left some out and failed on others."""
    saved = imports.uploads(files(spark, sf_dir))
    page = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 5
    parsed = saved.where(page != 0).select("book_id", F.when(page == 1, "broken").alias("error"))
    return imports.advanced(saved, parsed).select("book_id", "status")


@query("""SELECT doc_id AS book_id, CASE WHEN doc_id % 4 = 0 THEN 'current' WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'upgrade' END AS action FROM documents""")
def q_reparse(spark, sf_dir):
    """Documents as books read anew: some by the same parser, some unreadable, some with another text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), imports.list_hash(F.split("text", "\n", -1)).alias("text_hash"))
    known = d.withColumn("parser_version", F.when(F.col("book_id") % 4 == 0, 7).otherwise(2))
    parsed = d.select("book_id", F.when(F.col("book_id") % 5 == 0, "x").alias("error"), F.when(F.col("book_id") % 3 == 0, "other").otherwise(F.col("text_hash")).alias("text_hash"))
    return imports.reparsed(known, parsed, 7)


@query("SELECT doc_id AS book_id, doc_id % 6 <> 0 AS whole FROM documents")
def q_legacy_import(spark, sf_dir):
    """Snapshots whose hash holds, and every sixth that is damaged."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.split("text", "\n", -1).alias("elements"))
    h = imports.list_hash(F.col("elements"))
    good, bad = imports.legacy(d.withColumn("elements_hash", F.when(F.col("book_id") % 6 == 0, F.lit("0")).otherwise(h)))
    return good.select("book_id", F.lit(True).alias("whole")).union(bad.select("book_id", F.lit(False).alias("whole")))


@query("""WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS book_id, c_custkey AS start, c_name AS id FROM customer WHERE c_nationkey % 2 = 0)
SELECT book_id, '[' || string_agg('{"start":' || start || ',"id":"' || id || '"}', ',' ORDER BY start, id) || ']' AS structure FROM c GROUP BY 1""")
def q_export_structure(spark, sf_dir):
    """Sections of approved books as JSON."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("book_id"), F.col("c_custkey").alias("start"), F.col("c_name").alias("id"))
    return imports.exported(c, c.where("book_id % 2 = 0").select("book_id").distinct())


@query("""SELECT CAST(c_nationkey AS BIGINT) AS book_id, CASE WHEN c_nationkey % 3 = 0 THEN 'original ' ELSE 'edited ' END || c_custkey AS title FROM customer WHERE c_nationkey % 2 = 0""")
def q_restore_original(spark, sf_dir):
    """Edited sections of approved books, those of every third put back."""
    c = table(spark, sf_dir, "customer").withColumn("book_id", F.col("c_nationkey").cast("long"))
    title = lambda word: c.select("book_id", F.concat(F.lit(word), "c_custkey").alias("title"))
    books = c.select("book_id").distinct()
    return imports.restored(title("edited "), title("original "), books.where("book_id % 3 = 0"), books.where("book_id % 2 = 0"))
