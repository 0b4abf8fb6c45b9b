"""A stored full-text index in blocks: stemmed postings, ranges and bounds in the headers, best hits without reading all of it.

The postings of a token in a book are cut into cells of the book's text, the same cells for all tokens. A block is what a token has in a cell; its header
tells how many postings it holds, which range they cover, and the largest frequency and shortest length among them. From these
follows a bound for every score in the cell. A search reads the headers of its tokens, scores the cells of the largest bounds until they
hold enough hits, and then only the cells whose bound reaches the score of the last one of these. Blocks outside the ranges asked for are
passed over by their headers. Everything is by book, so many books can be searched at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.lexical import K1, B

#: Characters of a cell, and postings of one Arrow batch, about.
CELL, BATCH = 1 << 16, 50_000
_WORD = re.compile(r"[^\W_]+")
_ENDINGS = sorted(T.ENDINGS, key=len, reverse=True)


def stem(token: str) -> str:
    """A lower-case token with ё as е, without the longest listed ending that leaves four letters."""
    token = token.replace("ё", "е")
    return next((token[: -len(e)] for e in _ENDINGS if token.endswith(e) and len(token) >= len(e) + 4), token)


def query_tokens(query: str, stemmed: bool = True) -> list[str]:
    """The distinct tokens of a query as the index has them."""
    found = _WORD.findall(query.lower())
    return list(dict.fromkeys(map(stem, found) if stemmed else found))


def postings(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """(book_id, id, start_char, end_char, token, tf, dl) of docs(book_id, id, start_char, end_char, text).

    Counted within each text. Every text also has a row of the token "" and frequency 0, so that texts without tokens count as well."""
    kind = dict(docs.dtypes)["book_id"]
    names = ["book_id", "id", "start_char", "end_char", "token", "tf", "dl"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, str] = {}
        at: list[int] = []
        token: list[str] = []
        tf: list[int] = []
        dl: list[int] = []
        for b in batches:
            keys = pa.table(b.columns[:4], names=names[:4])

            def out(keys=keys) -> pa.RecordBatch:
                rows = keys.take(pa.array(at, pa.int64())).combine_chunks()
                return pa.RecordBatch.from_arrays([*(rows.column(i).combine_chunks() for i in range(4)), pa.array(token, pa.string()), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], names)

            for i, text in enumerate(b.column(4).to_pylist()):
                words = _WORD.findall((text or "").lower())
                n = len(words)
                if stemmed:
                    if len(seen) > 200_000:
                        seen.clear()
                    words = [seen.get(w) or seen.setdefault(w, stem(w)) for w in words]
                counts = Counter(words)
                at += [i] * (len(counts) + 1)
                token += ["", *counts]
                tf += [0, *counts.values()]
                dl += [n] * (len(counts) + 1)
                if len(at) >= BATCH:
                    yield out()
                    at, token, tf, dl = [], [], [], []
            if at:
                yield out()
                at, token, tf, dl = [], [], [], []

    rows = docs.select("book_id", F.col("id").cast("string"), F.col("start_char").cast("long"), F.col("end_char").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"book_id {kind}, id string, start_char long, end_char long, token string, tf long, dl long")


def build(rows: DataFrame, cell: Column | None = None, tokens: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, statistics) of postings: blocks(book_id, token, cell, n, most, least, low, high, postings), statistics(book_id, docs, mean).

    ``cell`` is by default the part of CELL characters that a text starts in. With tokens(book_id, token) only their blocks are
    made, for an index that is used once: the postings of other tokens aren't shuffled. The statistics are of all texts."""
    stats = rows.where("token = ''").groupBy("book_id").agg(F.count("*").alias("docs"), F.avg("dl").alias("mean"))
    place = F.floor(F.col("start_char") / CELL).cast("long") if cell is None else cell.cast("long")
    each = F.array_sort(F.collect_list(F.struct("start_char", "end_char", "id", "tf", "dl")))  # of one cell
    own = rows.where("token <> ''")
    if tokens is not None:
        own = own.join(F.broadcast(tokens.select("book_id", "token").distinct()), ["book_id", "token"], "left_semi")
    blocks = own.withColumn("cell", place).groupBy("book_id", "token", "cell").agg(
        F.count("*").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"), F.min("start_char").alias("low"), F.max("end_char").alias("high"), each.alias("postings"))
    return blocks, stats


def _impact(tf: str, dl: str) -> Column:
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.col("mean")))


def search(blocks: DataFrame, stats: DataFrame, queries: DataFrame, k: int, ranges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, cells): the k best texts of each book for queries(book_id, token) by BM25, ties by id, and the cells (book_id, cell) that were read.

    hits(book_id, id, start_char, end_char, score, rank). Only texts that overlap one of ranges(book_id, start_char, end_char) are
    hits, but frequencies are those of the whole book. Scores are rounded to 9 digits, so that ties don't depend on the order of sums."""
    own = blocks.join(queries.select("book_id", "token").distinct(), ["book_id", "token"])
    df = own.groupBy("book_id", "token").agg(F.sum("n").alias("df")).join(stats, "book_id")
    df = df.select("book_id", "token", "mean", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    head = own.select("book_id", "token", "cell", "n", "most", "least", "low", "high")
    asked = None if ranges is None else ranges.select(F.col("book_id").alias("__book"), F.col("start_char").alias("__from"), F.col("end_char").alias("__to")).distinct()

    def inside(rows: DataFrame, low: str, high: str) -> DataFrame:
        if asked is None:
            return rows
        return rows.join(asked, (F.col("book_id") == F.col("__book")) & (F.col(low) < F.col("__to")) & (F.col(high) > F.col("__from")), "left_semi")

    bounds = inside(head, "low", "high").join(df, ["book_id", "token"]).groupBy("book_id", "cell").agg(F.sum(F.col("idf") * _impact("most", "least")).alias("bound"), F.max("n").alias("sure"))
    w = Window.partitionBy("book_id").orderBy(F.desc("bound"), "cell")  # a row for each cell of a book
    ranked = bounds.withColumn("before", F.coalesce(F.sum("sure").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def scored(cells: DataFrame) -> DataFrame:
        each = own.join(cells.select("book_id", "cell"), ["book_id", "cell"], "left_semi").join(df, ["book_id", "token"])
        rows = inside(each.select("book_id", "mean", "idf", F.inline("postings")), "start_char", "end_char")
        return rows.groupBy("book_id", "id", "start_char", "end_char").agg(F.round(F.sum(F.col("idf") * _impact("tf", "dl")), 9).alias("score"))

    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("score"), "id"))
    first = ranked.where(F.col("before") < k)
    sure = scored(first)
    last = sure.withColumn("rank", rank).where(F.col("rank") <= k).where(F.col("rank") == k).select("book_id", F.col("score").alias("least"))
    # what can't reach the k-th score so far isn't read; the margin is for roundings
    rest = ranked.where(F.col("before") >= k).join(last, "book_id", "left").where("least is null or bound * (1 + 1e-9) + 1e-9 >= least")
    hits = sure.unionByName(scored(rest)).withColumn("rank", rank).where(F.col("rank") <= k)
    return hits, first.select("book_id", "cell").unionByName(rest.select("book_id", "cell"))
