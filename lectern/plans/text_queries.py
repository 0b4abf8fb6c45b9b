"""Queries over texts: elements, units, chunks, lexical search, hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import spans
from lectern.functions import text as T
from lectern.operators import lexical, search, sessions, structure
from lectern.plans.registry import query, table

_LINES = """lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS element FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
placed AS (SELECT doc_id, pos, element, coalesce(sum(length(element) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lines)"""
_PARAS = _LINES + """,
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, CAST(s + length(element) - length(regexp_replace(element, '^\\s+', '')) AS BIGINT) AS l, CAST(s + length(regexp_replace(element, '\\s+$', '')) AS BIGINT) AS r FROM placed WHERE regexp_matches(element, '\\S'))"""
_GLUE = _PARAS + """,
short AS (SELECT p.* FROM paras p JOIN (SELECT doc_id FROM paras GROUP BY doc_id HAVING max(r - l) <= 1200) USING (doc_id)),
glue AS (SELECT doc_id, k, l AS cl, r AS cr FROM short WHERE k = 1
UNION ALL SELECT p.doc_id, p.k, CASE WHEN g.cr - g.cl < 400 AND p.r - g.cl <= 1200 THEN g.cl ELSE p.l END, p.r FROM glue g JOIN short p ON p.doc_id = g.doc_id AND p.k = g.k + 1),
chunks AS (SELECT doc_id, cl AS start_char, max(cr) AS end_char FROM glue GROUP BY doc_id, cl)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(s AS BIGINT) AS start_char, CAST(s + length(element) AS BIGINT) AS end_char FROM placed")
def q_element_offsets(spark, sf_dir):
    return structure.element_offsets(structure.elements(documents(spark, sf_dir), "doc_id"), "doc_id")


@query("""WITH u AS (SELECT doc_id, regexp_extract_all(text, '(?s).+?(?:[.!?…][»”"]?\\s+|\\n+|$)') AS l FROM documents),
x AS (SELECT doc_id, unnest(range(len(l))) AS unit, unnest(l) AS t FROM u)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, CAST(length(t) AS INTEGER) AS n_chars FROM x""")
def q_sentence_units(spark, sf_dir):
    u = documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentence_units(F.col("text"))).alias("unit", "t")).select("doc_id", "unit", F.length("t").alias("n_chars"))
    before = F.sum("n_chars").over(Window.partitionBy("doc_id").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1))
    return u.select("doc_id", "unit", F.coalesce(before, F.lit(0)).cast("long").alias("start_char"), "n_chars")


def paragraphs(docs):
    """(doc_id, start_char, end_char, n) of trimmed lines that aren't blank."""
    lines = structure.elements(docs, "doc_id")
    trimmed = lines.select("doc_id", "pos", F.length("element").alias("n"), F.length(F.regexp_replace("element", r"(?U)^\s+", "")).alias("left"), F.length(F.regexp_replace("element", r"(?U)\s+$", "")).alias("right"))
    start = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = trimmed.select("doc_id", (start + F.col("n") - F.col("left")).cast("long").alias("start_char"), (start + F.col("right")).cast("long").alias("end_char"), "left")
    return placed.where("left > 0").drop("left")


@query(f"WITH {_PARAS} SELECT doc_id, l AS start_char, r AS end_char FROM paras")
def q_paragraph_spans(spark, sf_dir):
    return paragraphs(documents(spark, sf_dir))


def chunk_rows(docs, least=400, most=1200):
    """(doc_id, start_char, end_char) of the chunks of whole texts; one pass, no shuffle."""
    found = docs.select("doc_id", F.explode(spans.chunks(F.col("text"), least, most)).alias("c"))
    return found.select("doc_id", F.col("c.start_char").cast("long").alias("start_char"), F.col("c.end_char").cast("long").alias("end_char"))


def short_lined(docs, most=1200):
    """Documents none of whose trimmed lines is longer than ``most``."""
    lines = F.split("text", "\n", -1)
    return docs.where(F.forall(lines, lambda x: F.length(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) <= most))


@query(f"WITH RECURSIVE {_GLUE} SELECT doc_id, start_char, end_char FROM chunks")
def q_chunks_short(spark, sf_dir):
    return chunk_rows(short_lined(documents(spark, sf_dir)))


@query()
def q_chunks_full(spark, sf_dir):
    return chunk_rows(documents(spark, sf_dir))


@query(f"""WITH RECURSIVE {_GLUE} SELECT doc_id, start_char, end_char, CAST(lag(start_char) OVER w AS BIGINT) AS previous_start, CAST(lead(start_char) OVER w AS BIGINT) AS next_start,
substr(text, CAST(start_char + 1 AS BIGINT), 40) AS head, coalesce(substr(text, CAST(greatest(lag(start_char) OVER w, lag(end_char) OVER w - 200) + 1 AS BIGINT), CAST(least(200, lag(end_char) OVER w - lag(start_char) OVER w) AS BIGINT)), '') AS tail_before
FROM chunks JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start_char)""")
def q_chunk_chain_context(spark, sf_dir):
    """Chunks with their neighbours in documents without long lines, which is what the SQL can glue; q_chunk_chain_full has all documents."""
    return search.chunk_context(short_lined(documents(spark, sf_dir)), "doc_id")


@query()
def q_chunk_chain_full(spark, sf_dir):
    """Chunks with their neighbours in all documents, long lines split."""
    return search.chunk_context(documents(spark, sf_dir), "doc_id")


@query("SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def q_content_hash(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(T.content_hash(F.col("text")).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH h AS (SELECT n_nationkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('nation:' || n_name)) AS h FROM nation)
SELECT n_nationkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INTEGER, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def q_uuid5_ids(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", T.uuid5_url(F.concat(F.lit("nation:"), "n_name")).alias("uuid"))


_BM25 = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: x = 'with')) AS t1 FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS mean, sum(CASE WHEN t0 > 0 THEN 1 ELSE 0 END) AS d0, sum(CASE WHEN t1 > 0 THEN 1 ELSE 0 END) AS d1 FROM t),
b AS (SELECT doc_id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / mean)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM t, s WHERE t0 > 0 OR t1 > 0)
"""


@query(_BM25 + "SELECT doc_id, round(score, 6) AS score FROM b")
def q_lexical_bm25(spark, sf_dir):
    return lexical.bm25(documents(spark, sf_dir), "doc_id", ["the", "with"]).select("doc_id", F.round("score", 6).alias("score"))


@query(_BM25 + "SELECT doc_id, round(score, 6) AS score FROM b")
def q_index_bm25(spark, sf_dir):
    """The same search from postings, as a stored index gives them."""
    d = documents(spark, sf_dir)
    found = lexical.bm25_from(lexical.postings(d, "doc_id"), lexical.statistics(d), "doc_id", ["the", "with"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


#: Letters that documents are written over in, so that their words have Russian endings.
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопкрстувшхыз"
_RUSSIAN = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(replace(translate(lower(text), '{_LATIN}', '{_CYRILLIC}'), 'ё', 'е'), '[\\pL\\pN]+')) AS w FROM documents),
n AS (SELECT w, count(*) AS n FROM w GROUP BY w), stems AS (SELECT w, n, CASE """ + " ".join(f"WHEN ends_with(w, '{e}') AND length(w) >= {len(e) + 4} THEN left(w, length(w) - {len(e)})" for e in sorted(T.ENDINGS, key=len, reverse=True)) + " ELSE w END AS stem FROM n)"


def russian(spark, sf_dir):
    return documents(spark, sf_dir).withColumn("text", F.translate(F.lower("text"), _LATIN, _CYRILLIC))


@query(f"WITH {_RUSSIAN} SELECT stem AS token, doc_id, count(*) AS tf FROM w JOIN stems USING (w) GROUP BY 1, 2")
def q_stemmed_postings(spark, sf_dir):
    """Postings of all documents in Russian letters, with Russian stems."""
    return lexical.postings(russian(spark, sf_dir), "doc_id", stemmed=True).select("token", "doc_id", "tf")


@query(_BM25 + "SELECT doc_id, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank, true AS truncated FROM b QUALIFY rank <= 20")
def q_lexical_topk_or(spark, sf_dir):
    """A top-20 report of the search for either word, with the probe for more."""
    scored = lexical.bm25(documents(spark, sf_dir), "doc_id", ["the", "with"]).withColumn("score", F.round("score", 6))
    best, more = lexical.top(scored, "doc_id", 20)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))  # 20 rows
    return best.select("doc_id", rank.alias("rank")).join(F.broadcast(more))


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN]+'))) AS token FROM documents)
SELECT token, count(*) AS df, min(doc_id) AS first_id FROM w GROUP BY token""")
def q_inverted_index(spark, sf_dir):
    return lexical.document_frequency(documents(spark, sf_dir), "doc_id").withColumnRenamed("first", "first_id")


@query("""WITH p AS (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS t, len(l) AS n FROM (SELECT doc_id, string_split(lower(text), ' the ') AS l FROM documents)),
o AS (SELECT doc_id, k, n, CAST(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) + 5 * k AS BIGINT) AS start_char FROM p)
SELECT doc_id, CAST(k AS INTEGER) AS k, start_char, start_char + 5 AS end_char FROM o WHERE k < n - 1""")
def q_substring_hits(spark, sf_dir):
    """All non-overlapping places of a phrase, case-insensitive."""
    return lexical.substring_hits(documents(spark, sf_dir), "doc_id", " the ")


def quote_hits(spark, sf_dir):
    """(doc_id, item_id, start) of documents that hold an item's text."""
    return lexical.containing(documents(spark, sf_dir), "doc_id", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("SELECT doc_id, item_id, CAST(strpos(d.text, b.text) - 1 AS INTEGER) AS start_char FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q_evidence_contained(spark, sf_dir):
    return quote_hits(spark, sf_dir).withColumnRenamed("start", "start_char")


@query()
def q_evidence_spans(spark, sf_dir):
    """The sentences that hold each quoted item."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = quote_hits(spark, sf_dir).join(documents(spark, sf_dir), "doc_id").join(quotes, "item_id").withColumn("span", spans.evidence_span(F.col("text"), F.col("quote")))
    return found.select("doc_id", "item_id", "span.start_char", "span.end_char")


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]+'))) AS n_terms, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n_clean FROM documents")
def q_clean_and_terms(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(F.array_distinct(T.tokens(F.col("text")))).cast("long").alias("n_terms"), F.length(T.clean(F.col("text"))).cast("long").alias("n_clean"))


@query("""WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 80 THEN text ELSE rtrim(substr(text, 1, 79)) || '…' END AS short,
substr(text, CAST(greatest(0, least(greatest(0, 100 - 25), n - 60)) + 1 AS BIGINT), 60) AS around FROM n""")
def q_excerpts(spark, sf_dir):
    """Shortened texts and 60 characters around the range 100..110."""
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.shorten(t, 80).alias("short"), T.window_around(t, F.lit(100), F.lit(110), 60).alias("around"))


@query(f"WITH {_RUSSIAN} SELECT w AS word, stem, n FROM stems")
def q_stems(spark, sf_dir):
    """Every word of the documents in Russian letters with its stem."""
    words = russian(spark, sf_dir).select(F.explode(F.regexp_extract_all(T.fold(F.col("text")), F.lit(T.WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("stem", T.stem(F.col("word")))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), f AS (SELECT h, min(doc_id) AS first_id FROM d GROUP BY h)
SELECT h AS text_hash, first_id FROM f WHERE h NOT IN (SELECT h FROM d WHERE doc_id % 3 = 0)""")
def q_cache_misses(spark, sf_dir):
    """Distinct texts that a cache filled by every third document lacks, in first-seen order of ids."""
    d = documents(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("text_hash"))
    return d.groupBy("text_hash").agg(F.min("doc_id").alias("first_id")).join(d.where("doc_id % 3 = 0"), "text_hash", "left_anti").select("text_hash", "first_id")


@query("""WITH c AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations WHERE role IN ('user', 'assistant')),
r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back FROM c)
SELECT conv_id, turn, role, CAST(back AS BIGINT) AS tokens_to_end FROM r WHERE back <= 400""")
def q_history_tail(spark, sf_dir):
    """The newest messages of each conversation within a budget; the first overflow ends the tail."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return sessions.history_tail(c, "conv_id", "turn", F.col("n"), 400).select("conv_id", "turn", "role", "tokens_to_end")
